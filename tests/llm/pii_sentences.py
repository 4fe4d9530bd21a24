"""Sentences with personal information, written apart from the training table; no two share a carrier with it.

``[[type|text]]`` marks what is to be found, everything else must stay.
"""

SENTENCES = """
Yesterday the caretaker, [[person_name|Oskar Lindqvist]], repaired the boiler.
The jury chose [[person_name|Mira Bergquist]] over eleven others.
Nobody but [[person_name|Lena Holm-Tarr]] remembered the password.
Have you seen [[person_name|Peter Smith]] lately?
The goal was scored by [[person_name|Ann Lee]] in the last minute.
Interview with [[person_name|Oskar B. Smith]], gardener
His grandmother [[person_name|Mira de Vann]] kept bees.
Treasurer: [[person_name|Lee, Peter]]
Chaired by Prof. [[person_name|Lena Bergquist]]
The estate of [[person_name|Peter van Dorn]] was sold.
Wedding of [[person_name|Ann Smith]] and [[person_name|Oskar Lee]]
Der Hausmeister [[person_name|Oskar Bergquist]] hat den Schlüssel.
Gestern war [[person_name|Lena Smith]] bei uns zum Essen.
Le gardien [[person_name|Peter Holm-Tarr]] a les clés.
La directrice [[person_name|Mira Lee]] est partie hier.
El portero [[person_name|Oskar de Vann]] tiene la llave.
Ayer vino [[person_name|Ann Bergquist]] a cenar.
sincerely yours, [[person_name|lena bergquist]]
SIGNED BY [[person_name|PETER SMITH]]
Witness statement of Ms [[person_name|Mira Smith]], page 3
Applications should reach [[email|jobs.north@harbour.example]] by noon.
For refunds use [[email|refund+eu@shop.example.org]] only.
I lost access to [[email|t.hansen82@inbox.test]] last year.
Her new one is [[email|k_moreau@posta.example.net]], I think.
Spam keeps coming from [[email|win-now@lottery.example.com]]!
Try [[email|info (at) verein (dot) example]] instead.
Ask [[email|hannah at garden dot example]] about seeds.
user=[[email|p.weber@firma.example]] status=ok
Schick die Fotos an [[email|oma.berta@post.example]] bitte.
Le devis est à demander à [[email|devis@atelier.example]].
Manda las fotos a [[email|fotos@boda.example.org]] hoy.
"[[email|m.rossi@studio.example]]" bounced twice
If the alarm rings, phone [[phone|+44 20 7946 0812]] at once.
The plumber can be had on [[phone|(020) 7946-0355]] all week.
Leave a message at [[phone|555-010-7788]] after the tone.
My landline, [[phone|+1 415 555 0133]], has been cut.
Grandpa still answers [[phone|030 5550 1234]] every evening.
Hotline [[phone|+49 89 5550123]] (free of charge)
Der Notdienst hat die [[phone|+49 40 5550 777]] geschaltet.
Le plombier répond au [[phone|01 55 50 12 34]] jusqu'à midi.
El fontanero atiende en el [[phone|+34 915 550 123]] siempre.
sms to [[phone|+61 491 570 156]] failed
booking_phone: [[phone|+33 1 55 50 98 76]]
The number on the van was [[phone|202-555-0178]].
Her social security number, [[id_number|512-48-9921]], was on the slip.
The bank asked for a tax id and received [[id_number|98 123 456 780]].
Passport holder number [[id_number|C4F7788123]] boarded last.
A copy of his passport ([[id_number|X1234567]]) was in the bin.
Employee SSN [[id_number|219-09-9999]] must be masked.
national_id=[[id_number|85073003328]]
Seine Steuernummer [[id_number|181/815/08155]] stand auf dem Umschlag.
Die Sozialversicherungsnummer [[id_number|15 070649 C 103]] fehlt noch.
Son numéro de sécurité sociale, [[id_number|2 55 08 14 168 025 38]], est faux.
El DNI del cliente es [[id_number|12345678Z]].
The insurance number [[id_number|QQ 12 34 56 C]] is a sample.
His national identity card reads [[id_number|AB-1234-567]].
The parade starts outside [[street_address|14 Cedar Street]] at ten.
Our grandparents built [[street_address|7 Hill Road]] in 1931.
Burglars entered [[street_address|220 West Maple Ave]] through the roof.
We rented [[street_address|3b Orchard Lane]] for the summer.
Parking behind [[street_address|19 Station Road]] is free.
The notary sits in [[street_address|88 Lincoln Blvd]], second door.
Der Kindergarten ist in der [[street_address|Gartenstraße 12]].
Abgestellt vor der [[street_address|Lindenallee 7a]] seit gestern.
La mairie annexe est au [[street_address|24 rue des Lilas]].
Le colis attend [[street_address|9 bis avenue Pasteur]].
El notario está en [[street_address|Calle Mayor 41]].
La fiesta es en [[street_address|Plaza Cervantes, 3]] mañana.
site_address="[[street_address|51 Priory Close]]"
Release 4.2.1 came out on 2021-03-04 and broke 17 plugins.
The build number 20210304123456 is printed in the footer.
Use git@forge.example:team/tool.git as the remote.
Log in with ssh admin@10.0.0.7 and restart the daemon.
lodash@4.17.21 has a known hole.
The Baltic Sea froze in January.
Kubernetes and Apache Spark share the cluster.
Flight 8123 leaves from gate 14 at 09:35.
Der Zug fährt auf Gleis 12 ab.
Le fichier contient 48210 lignes.
La tabla tiene 300 columnas y 12 índices.
""".strip().splitlines()
