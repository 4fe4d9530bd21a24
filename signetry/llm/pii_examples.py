"""The small labelled table the tagger of personal information is trained on.

A line of the table is a sentence with slots. Slots in capitals are personal information and labelled with its
type; slots in small letters are look-alikes that must stay unlabelled. The values put into the slots are
invented from syllables, known name parts are mixed in.
"""

from __future__ import annotations

import random
import re
import string

TYPES = ("email", "phone", "id_number", "street_address", "person_name")
SLOT_TYPE = {"EMAIL": "email", "PHONE": "phone", "ID": "id_number", "ADDRESS": "street_address", "ADDRESS_FR": "street_address", "ADDRESS_ES": "street_address", "ADDRESS_DE": "street_address", "NAME": "person_name", "KNOWN": "person_name"}

CARRIERS = """
{NAME}
{NAME}
{NAME}
{NAME}
{NAME}
{PHONE}
{PHONE}
{EMAIL}
{EMAIL}
{ADDRESS}
{ADDRESS}
{ADDRESS_FR}
{ADDRESS_ES}
{ADDRESS_DE}
{NAME}, {ADDRESS}, {PHONE}
{NAME} - {PHONE} - {EMAIL}
{EMAIL} / {PHONE}
{PHONE} or {EMAIL}
{PHONE} - {NAME}
| {NAME} | {EMAIL} | {PHONE} |
| {num} | {NAME} | {ADDRESS} |
{num},{NAME},{EMAIL},{date}
{num};{NAME};{PHONE};{ADDRESS_DE};{num}
{num};{ADDRESS_FR};{NAME};{num}
{num};{ADDRESS_ES};{PHONE};{num}
{ident};{NAME};{ADDRESS};{PHONE}
{NAME};{ID};{date};{num}
{"first_contact": "{NAME}", "email": "{EMAIL}"}
{"customer": {"full_name": "{NAME}", "id": "{ID}", "phone": "{PHONE}"}}
{"name": "{NAME}", "street": "{ADDRESS}", "zip": "{num}"}
{"tax_id": "{ID}", "holder": "{NAME}"}
{"patient": "{NAME}", "insurance": "{ID}", "doctor": "{NAME}"}
<td>{NAME}</td><td>{PHONE}</td>
<li>{NAME} ({EMAIL})</li>
INFO {date} {ident}: login name='{NAME}' phone={PHONE} tries={num}
{date} ERROR {ident} customer="{NAME}" mail={EMAIL}
{date} DEBUG {ident} caller='{PHONE}' name='{NAME}' id={num}
name={NAME} address={ADDRESS} phone={PHONE}
client: {NAME}, ssn={ID}
phone = "{PHONE}"
contact = '{EMAIL}'
full_name = "{NAME}"
# written by {NAME}
// Copyright (c) 2019 {NAME} <{EMAIL}>
# copyright {NAME}, all rights reserved
/* contributed by {NAME} */
@author {NAME}
Author: {NAME} <{EMAIL}>
Reviewed-by: {NAME} <{EMAIL}>
From: {NAME} <{EMAIL}>
To: {EMAIL}
Cc: {NAME} <{EMAIL}>, {EMAIL}
Reply-To: {EMAIL}
On {date}, {NAME} <{EMAIL}> wrote:
Dear {NAME},
Dear Mr {NAME},
Dear Ms. {NAME}, thank you for your letter.
Dear Dr {NAME}, the results are ready.
Hello {NAME}, your parcel has arrived.
Hi, I'm {NAME} and I'm new to this town.
Hi, my name is {NAME}.
My name is {NAME} and I teach chemistry.
This is {NAME} from the front office.
I am {NAME}, the new tenant.
I'm {NAME}, I run the bakery next door.
Yours sincerely, {NAME}
Kind regards, {NAME}
Saludos, {NAME}
Grüße, {NAME}
Bien à vous, {NAME}
— {NAME}
— {NAME}
– {NAME}
-- {NAME}
Better ask {NAME} first.
just ask {NAME}, not me
ask {NAME} again tomorrow
the credit belongs to {NAME}
a big thank you goes to {NAME}
M. {NAME} l'a vu hier.
Mme {NAME} l'a dit.
Monsieur {NAME} l'avait promis.
Best wishes, {NAME}
Cheers, {NAME}
- {NAME}
~ {NAME}
Signed: {NAME}
Signature: {NAME}
Thank you, {NAME}.
Our neighbour {NAME} brought the keys back.
My teacher {NAME} explained it twice.
My sister {NAME} called yesterday.
My boss {NAME} approved the holiday.
The nurse {NAME} took the sample.
Our lawyer {NAME} will reply.
A friend, {NAME}, lent me the money.
The tenant {NAME} moved out in May.
According to {NAME}, the bridge was closed.
As {NAME} said at dinner, nobody came.
As {NAME} wrote last week, the meeting is off.
{word} {word} {KNOWN} {word}.
{thing} {word} {KNOWN} {word} {word}
{word} {KNOWN}, {word} {word}.
{thing} of {KNOWN} {word}
{word} {KNOWN} and {KNOWN} {word}
{thing} {thing} {word} {KNOWN}
{KNOWN} {word} {word} {word}.
{NAME} called about the invoice.
{NAME} won the second prize.
{NAME} told me to wait.
{NAME} will send the contract tomorrow.
{NAME} moved here three years ago.
{NAME} and {NAME} were both there.
The painting by {NAME} was sold.
A letter from {NAME} came today.
The patient is {NAME}, born in 1971.
Please forward this to {NAME}.
Please speak with {NAME} first.
Could you ask {NAME} whether it fits?
I met {NAME} at the station.
I talked to {NAME} on Monday.
Did {NAME} pay already?
Many thanks to {NAME} for the lift.
All credit to {NAME}, who did the work.
The idea came from {NAME}.
Mr. {NAME} parked in front of the gate.
Mrs {NAME} ordered two chairs.
Ms. {NAME} opened an account.
Miss {NAME} sings in the choir.
Dr. {NAME} prescribed rest.
Prof. {NAME} cancelled the lecture.
Professor {NAME} retired in June.
Account holder: {NAME}
Attention: {NAME}
Applicant: {NAME}
Cardholder name: {NAME}
Emergency contact: {NAME}, {PHONE}
Driver: {NAME}
Herr {NAME} kommt um acht.
Sehr geehrter Herr {NAME},
Sehr geehrte Frau {NAME}, vielen Dank.
Frau {NAME} hat den Vertrag unterschrieben.
Ich heiße {NAME} und wohne seit Mai hier.
Mein Name ist {NAME}.
Mein Bruder {NAME} fährt morgen.
Meine Nachbarin {NAME} hat angerufen.
Unsere Lehrerin {NAME} ist krank.
Laut {NAME} fällt der Termin aus.
Wie {NAME} sagte, war niemand da.
Mit freundlichen Grüßen, {NAME}
Gezeichnet: {NAME}
Monsieur {NAME} est absent.
M. {NAME} a signé le bail.
Mme {NAME} habite au troisième.
Madame {NAME} viendra demain.
Je m'appelle {NAME}.
Je suis {NAME}, votre voisin.
Mon frère {NAME} arrive ce soir.
Ma voisine {NAME} a téléphoné.
D'après {NAME}, le train est en retard.
Selon {NAME}, c'est fermé.
Cordialement, {NAME}
Le docteur {NAME} est en vacances.
El señor {NAME} pagó la cuenta.
La señora {NAME} vive arriba.
Don {NAME} abrió la tienda.
Me llamo {NAME}.
Soy {NAME}, el nuevo inquilino.
Mi hermano {NAME} llega hoy.
Mi vecina {NAME} me ayudó.
Nuestra profesora {NAME} está enferma.
Según {NAME}, no hay clase.
Como dijo {NAME}, nadie vino.
Un saludo, {NAME}
Atentamente, {NAME}
E-mail: {EMAIL}
Mail: {EMAIL}
email {EMAIL}
My mail is {EMAIL}, write any time.
My e-mail address is {EMAIL}.
Write to {EMAIL} for tickets.
Write me at {EMAIL} and I will answer.
Questions go to {EMAIL}.
Please reply to {EMAIL} before Friday.
You may contact us under {EMAIL}.
Contact {EMAIL} with any questions.
Reach our desk at {EMAIL} on weekdays.
The receipt was sent to {EMAIL} yesterday.
I mailed {EMAIL} but got no answer.
Forward it to <{EMAIL}>.
[{NAME}](mailto:{EMAIL})
<a href="mailto:{EMAIL}">mail</a>
new address: {EMAIL} (old one is dead)
{EMAIL} is the address of our treasurer.
Drop a line to {EMAIL}!
Add {EMAIL} to the list.
Meine E-Mail lautet {EMAIL}.
Schreiben Sie an {EMAIL}.
Anfragen bitte per Mail an {EMAIL}.
Erreichbar bin ich über {EMAIL}.
Mon courriel est {EMAIL}.
Contactez-nous à {EMAIL}.
Envoyez le dossier à {EMAIL}, merci.
Mi dirección de correo es {EMAIL}.
Escriba a {EMAIL} para reservar.
Contacto: {EMAIL}
Phone {PHONE}
Telephone: {PHONE}
Mobile: {PHONE}
Cell {PHONE}
Fax: {PHONE}
tel {PHONE}
T: {PHONE} / F: {PHONE}
tel:{PHONE}
Phone number: {PHONE}
For bookings dial {PHONE} before noon.
Our office number is {PHONE}, extension {num}.
{PHONE} ext. {num}
Ring me on {PHONE} tonight.
Give me a ring at {PHONE}.
Call us at {PHONE} or come by.
Please call {PHONE} after six.
You can call me back on {PHONE}.
My new number: {PHONE}
My mobile number is {PHONE}, the old one is off.
The hotline {PHONE} is always busy.
Send a text to {PHONE} when you land.
WhatsApp: {PHONE}
He left {PHONE} as his number.
We tried {PHONE} three times (no answer).
In an emergency call {PHONE}.
Dial {PHONE} and ask for the manager.
Reachable under {PHONE} at weekends.
Telefon {PHONE}
Handy: {PHONE}
Rufen Sie {PHONE} an.
Meine Nummer ist {PHONE}.
Telefonisch unter {PHONE} zu erreichen.
Téléphone : {PHONE}
Mon numéro est le {PHONE}.
Appelez-moi au {PHONE} ce soir.
Joignable au {PHONE}.
Tel.: {PHONE}
Mi número es {PHONE}.
Mi teléfono es el {PHONE}.
Llame al {PHONE} por la tarde.
Móvil: {PHONE}
SSN: {ID}
SSN {ID}
Social security no. {ID}
Social security number: {ID}
My social security number is {ID}.
The clerk wrote down my SSN, {ID}, on paper.
Tax ID: {ID}
Taxpayer number {ID}
Tax id of the seller: {ID}
The tax office filed me under {ID}.
National insurance number: {ID}
NI number {ID}
National ID {ID}
National identity number: {ID}
Identity card no. {ID}
Identity number {ID} was printed on the form.
ID number: {ID}
ID card: {ID}
Personal ID {ID}
Passport number: {ID}
Passport number {ID}
My passport, number {ID}, expires in June.
The passport {ID} was reported stolen.
Driver's license no. {ID}
Resident permit: {ID}
Insurance number of the patient: {ID}
He typed his identity number {ID} into the chat.
They leaked my tax number ({ID}).
His SSN {ID} was visible on the screen.
The form shows SSN {ID} in field two, is this allowed?
She read out her social security number, which is {ID}, over the phone.
They wanted my social security number so I sent {ID}.
The tax number {ID} belongs to my landlord.
Tax number {ID} appeared in the letter.
Taxpayer id {ID} is on every invoice.
Citizen card {ID}
Citizen number: {ID}
Our citizen id is {ID} according to the town hall.
"ssn": "{ID}",
"passport": "{ID}",
ssn = "{ID}"
passport: {ID}
The traveller's passport {ID} was scanned.
Passport no. {ID}, issued in {date}
Pass-Nr.: {ID}
Pasaporte {ID}
N.º de pasaporte: {ID}
Passeport n° {ID}
Documento de identidad: {ID}
DNI {ID} del titular
Die Ausweisnummer {ID} war unleserlich.
Steuer-ID: {ID}
Meine Steuernummer lautet {ID}.
Ausweis-Nr. {ID}
Meine Ausweisnummer ist {ID}.
Ausweisnummer {ID} liegt vor.
Personalausweis {ID}
Reisepass Nr. {ID}
Sozialversicherungsnummer: {ID}
Meine Passnummer ist {ID}.
Numéro fiscal : {ID}
Numéro de passeport : {ID}
Carte d'identité n° {ID}
Mon numéro fiscal est {ID}.
N° de sécurité sociale {ID}
DNI: {ID}
NIE {ID}
NIF: {ID}
Mi número de pasaporte es {ID}.
Número de identidad: {ID}
Mi número de la seguridad social es {ID}.
Address: {ADDRESS}
{word} {word} {ADDRESS} {word}.
{word} {ADDRESS}, {word} {word}
{thing} {word} {ADDRESS}.
{word} {ADDRESS} {word} {word}
the {word} near {ADDRESS} was {word}
{word} {word} {ADDRESS_DE} {word}.
{word} der {ADDRESS_DE} {word} {word}
{thing} {word} {ADDRESS_DE}.
{word} {ADDRESS_DE}, {word}
{word} au {ADDRESS_FR}.
{word} {word} {ADDRESS_FR} {word}
{word} du {ADDRESS_FR} {word} {word}.
{thing} {word} {ADDRESS_FR}, {word}.
{word} en {ADDRESS_ES} {word}.
{word} {word} {ADDRESS_ES} {word} {word}
{thing} {word} {ADDRESS_ES}.
{word} {word} {EMAIL} {word}.
{thing} {word} {EMAIL} {word} {word}
{word} {word} {PHONE} {word}.
{thing} {word} {PHONE}
Home address: {ADDRESS}
Delivery address: {ADDRESS}, third floor
Billing address {ADDRESS}
Our shop is at {ADDRESS}.
I stay at {ADDRESS}.
They live at {ADDRESS} with two cats.
Bring the books to {ADDRESS}; the bell is broken.
The office moved to {ADDRESS} in March.
She lives at {ADDRESS}, Apartment 5.
He lived at {ADDRESS} until 2015.
We are located at {ADDRESS}, next to the park.
Please deliver to {ADDRESS} before noon.
Please mail the form to {ADDRESS}, Springfield.
Meet me at {ADDRESS} at seven.
There was a fire at {ADDRESS} last night.
The house at {ADDRESS} is for sale.
The taxi waits at {ADDRESS}; hurry up.
Pick it up from {ADDRESS}, flat 12.
Visit us: {ADDRESS}
My parents own {ADDRESS}.
Return to sender, {ADDRESS}
{ADDRESS}, Unit 4
{ADDRESS}, Leeds
{NAME}, {ADDRESS}
Ich wohne in der {ADDRESS_DE}.
Wir wohnen {ADDRESS_DE}, dritter Stock.
Adresse: {ADDRESS_DE}
Lieferung an {ADDRESS_DE}, Hinterhof.
Die Praxis liegt {ADDRESS_DE}.
Er wohnt {ADDRESS_DE} bei seiner Mutter.
Sie wohnte {ADDRESS_DE} im Erdgeschoss.
Ich arbeite {ADDRESS_DE} im Hinterhaus.
Bringen Sie es in die {ADDRESS_DE} zurück.
Das Paket soll nach {ADDRESS_DE} gehen.
Bitte bei {ADDRESS_DE} klingeln.
Zugestellt an {ADDRESS_DE} gestern.
Unser Büro: {ADDRESS_DE}, 20095 Hamburg
Treffpunkt {ADDRESS_DE} um neun.
Il habite {ADDRESS_FR}.
J'habite au {ADDRESS_FR}, troisième étage.
Notre bureau : {ADDRESS_FR}, 69002 Lyon
Adresse de livraison : {ADDRESS_FR}
Rendez-vous au {ADDRESS_FR} à midi.
La boutique se trouve {ADDRESS_FR}.
Vive en {ADDRESS_ES}, tercer piso.
Domicilio: {ADDRESS_ES}
La oficina está en {ADDRESS_ES}.
Mi casa está en {ADDRESS_ES}, cerca del parque.
Enviar a {ADDRESS_ES}, 28004 Madrid
Quedamos en {ADDRESS_ES} a las ocho.
""".strip().splitlines()

LOOKALIKES = """
Ticket {ticket}
Ticket {ticket} waits for an answer.
See {ticket} for the details.
Fixed in {ticket}.
{ticket} is a copy of {ticket}.
Incident {ticket} was closed in {date}.
ticket: {ticket}
"ticket": "{ticket}",
ref = "{ticket}"
part = "{part}"
Release {ticket}
See {family} for a proof.
The {family} method converges.
The {family}-{family} equation is older.
In {family} there is a chapter about it.
After {family} the field changed.
When {family} wrote it, nobody cared.
As {family} shows, it is hard.
Since {family} this is known.
Das {family}-Verfahren ist langsam.
Nach {family} gilt das nicht.
Selon {family}, c'est faux.
Según {family} es falso.
Le théorème de {family} suffit.
The {given} {family} award goes to a team.
The {given} {family} branch was deleted.
The {given} {family} data set is public.
Will {family} {num} be on time?
Will {thing} {num} open again?
Max {family} width is {num}.
Max {thing} size is {num}.
{given} {family} and {given} {family} are only test labels.
In {family}'s book the sign is wrong.
The {family} constant is not the {family} number.
Max Value is {num}.
Max Length {num}
Will Work In {num}
Will Start Soon
Grace Period {num} days
Grace Time is {num}.
Mark As Read
Mark Item {num} as done.
Bill Amount {num}
Amber Light means wait.
Amber Phase {num} is over.
Rose Garden opens at {num}.
Ruby Gem {num}
Jade Template {num}
Hope Valley and Dawn Chorus are album titles.
Faith School {num}
{given} {num}
{given} Server {num} is down.
{given} Project
{noun} {given} {num}
Der {thing} ist kaputt.
Die {thing} fehlt im {thing}.
Zuerst {thing} prüfen, dann {thing} öffnen.
Zuerst {thing} laden.
Dann {thing} speichern.
Danach {thing} löschen und {thing} anlegen.
Neue {thing} braucht das Land.
Meine {thing} zeigt nur {thing} an.
Ohne {thing} geht es nicht.
Bitte {thing} prüfen.
Kein {thing} gefunden
Gibt es {thing} für {thing}?
Viele Grüße
Liebe Grüße
Beste Grüße
Schöne Grüße aus Köln
Je pense que {thing} suffit.
Creo que {thing} funciona.
You should check the {noun}.
Think about the {noun} first.
Thanks {given}!
Thank you {given}, it works now.
Hi {given},
Hello {given}, any news?
{given} is on holiday.
{given} said it would rain.
I asked {given} and got no reply.
My dog {given} barks at night.
The {family} theorem is older than the {family} lemma.
{family}'s rule does not apply here.
A {family} filter removes the noise.
The {family} report was published in 1998.
Mr. {family} is not in the office.
Herr {family} ist nicht da.
Mme {family} est absente.
{family} et al. ({num}) disagree.
The {given} release of the {noun}.
{letter}. The second option is better.
{letter} {letter} {letter}
@{handle} could you post the log?
@{handle}: no.
cc @{handle} @{handle}
The Red Cross and the United Nations met.
Visual Studio Code, Google Chrome and Mozilla Firefox all do it.
New York, Los Angeles and San Francisco are far away.
South Africa and New Zealand played a draw.
The Main Menu has a Close Button and a Print Preview.
Monday Morning, Friday Night and Sunday Afternoon
Happy Birthday and Merry Christmas
Best Regards
Kind Regards
Good Morning
Any Help Appreciated
Hello World
Hello everyone, first post here.
Open Source Software Licence
Final Report Draft
Null Pointer Exception
Internal Server Error
Access Denied For User
General Terms and Conditions
Park Road School and Bridge Street Market are closed.
The street was empty and the road was wet.
Take the second road on the right after {num} metres.
There are {num} lanes on the main road.
{num} way street
Route {num} goes west.
Highway {num} is blocked.
Drive {num} is full, drive {num} is fine.
Room {num}, floor {num}
{num} Square metres
{num} Close matches were found in court records.
Section {num} Court rules
Step {num} Drive the screw in.
Die Straße ist {num} Meter lang.
Auf dem Weg dorthin sind {num} Häuser.
La rue est longue de {num} mètres.
La calle tiene {num} casas.
La plaza estaba llena.
Version {version} of the {noun}
v{version}
{ident}=={version}
{ident}@{version}
npm i {ident}@{version} {ident}@{version}
pip install {ident}>={version}
git remote add origin git@host.{word}.example:{ident}/{ident}.git
git clone ssh://git@{word}.example/{ident}.git
scp file.txt {handle}@{ip}:/tmp
ssh {handle}@{word}.example
ssh -p {port} root@{ip}
rsync -av {ident}/ backup@{word}.example:/srv/{ident}
psql -h {ip} -U {handle}
ftp://{handle}@{word}.example/{ident}
{ip}:{port}
ping {ip}
inet {ip}/24 port {port}
Listening on {ip}:{port}
https://www.{word}.example/{word}?id={bignum}
http://{word}.example:{port}/{ident}/{num}
![image](https://img.{word}.example/{hash}.png)
[1]: http://{word}.example/{word}/{bignum}
Order number {order} was shipped.
Order {order}
Invoice {bignum}-{num} from {date}
Your reference: {part}
Serial no. {part}
Model {part}
Part {part} is sold out.
Article {ssn} in the catalogue
Case number {ssn}
Ticket {ssn} is closed.
Issue {num}-{num}
Bug {bignum}
Tracking code {bigdigits}
Batch {bigdigits}
ISBN {isbn}
{epoch}
{epoch} {bignum}
timestamp={epoch}
created_at: {epoch}
{date}
{date} {num}:{num}
on {date} we had {num} visitors
{bignum} {bignum} {bignum}
{bignum};{bignum};{num}
{bignum},{num},{epoch},{num}
{num}.{num}.{num}
{num}/{num}
{num}-{num}
({num}, {num})
[{num}, {num}, {bignum}]
x = {bignum} + {num}
{hash}
commit {hash}
sha256:{hash}
id: {hash}
"id": {bignum},
"checksum": "{hash}",
"size": {bigdigits},
"version": "{version}",
"created": "{date}",
exit code {num}
Exception in thread "main" {ident}: {num}
at {ident}.{ident}({ident}.java:{num})
line {num}, in {ident}
{ident}: {num}
{ident} = {num}
{ident}.{ident} = "{word}"
if {ident} > {num}:
for {word} in {ident}:
    x = {ident}[{num}]
    print({ident})
def {ident}(self, {word}):
class {ident}:
from {word} import {ident}
import {ident}
#include <{word}.h>
return {ident}({word})
@{ident}
@{ident}("{word}")
SELECT {word}, {word} FROM {ident} WHERE {word} = {num};
INSERT INTO {ident} VALUES ({num}, '{word}', {bignum});
<div class="{word}">{num}</div>
<b>{word}</b>
{"{word}": {num}, "{word}": "{date}"}
{date} INFO {ident}: took {num} ms
{date} WARN {ident} code={num} retry={num}
drwxr-xr-x {num} {word} {word} {bignum} {word}
| {word} | {num} | {bignum} |
**Note:** the {noun} is deprecated.
Is there a way to merge two {noun}s?
Does anybody know how the {noun} works?
How do I reset the {noun} after a crash?
How can I convert a {noun} into a {noun}?
The {noun} fails with {num} items but not with {num}.
I have tried to restart the {noun}, without luck.
You should not store a {noun} inside a {noun}.
It took {num} hours, {bignum} rows were lost.
Please add a minimal example to your question.
Welcome! Please read the rules at the top.
This question was asked {num} times before.
The answer above is wrong since {date}.
Never mind, I found it.
Same here with {version}.
The population rose from {bignum} to {bignum}.
About {num} of {bignum} people agreed.
Prices start at {num} euros and end at {bignum}.
Call the function {ident} with {num} arguments.
Write to the {noun} before you read it.
Contact the support team of your provider.
My number of rows is {bignum}.
My address space is {num} bits.
Ask the admin for a new password.
We live in a small town near the sea.
Send the signal {num} to the process {bignum}.
Die Datei hat {bignum} Zeilen und {num} Spalten.
Wie kann ich die Tabelle neu laden?
Das Programm stürzt seit {date} ab.
Seit Version {version} ist alles langsamer.
Ich habe {num} Versuche gebraucht.
Guten Morgen zusammen
Vielen Dank im Voraus
Mit freundlichen Grüßen
Ein neuer Ordner mit großem Namen wurde angelegt.
Der Fehler Nummer {num} tritt beim Start auf.
Le programme plante depuis la version {version}.
Comment supprimer une ligne du fichier ?
J'ai essayé {num} fois sans succès.
Bonjour à tous
Merci d'avance
Le serveur écoute sur le port {port}.
Il y a {bignum} lignes dans la base.
El programa falla desde la versión {version}.
¿Cómo puedo abrir el archivo?
Lo intenté {num} veces.
Buenos días a todos
Muchas gracias
Hay {bignum} filas en la tabla.
El puerto {port} está ocupado.
""".strip().splitlines()

_NOUNS = "config queue loom kettle ledger matrix report cache schema heddle valve window driver index gasket edge list test set rating log audit trail dye bath stitch counter".split()
_NOUNS_DE = "Datei Tabelle Ordner Fehler Fenster Drucker Spalte Zeile Server Update Bericht Filter Schlüssel Speicher Anzeige Eingabe Ausgabe Liste".split()
_ONSETS = "b br c d dr f g gl h j k kr l m n p q r s sk st t th v w y z zh".split()
_VOWELS = "a e i o u ae ei ou ia ö å ı é y".split()
_CODAS = ["", "n", "l", "r", "s", "sk", "m", "x", "lm", "rr", "nn", "st", "ch"]
_FAMILY_ENDS = "man dal quist sen ez ard oglu ski kos tini eira strøm ström bach wick ton ov enko ic lenko ey ab u".split()
_GIVEN_ENDS = "a o e is or el an une eth ti us i elle in".split()
_PARTICLES = ["de ", "van ", "von ", "D'", "O'", "Mac", "Mac", "al-", "di ", "da ", "del ", "van der ", "le ", "bin "]
_STREETS = "Church Station Park Victoria King Queen Maple Cedar Chestnut Lincoln Washington Harbour Garden Hill Bridge Market School Forest River Lake Spring Sunset Baker Castle Abbey Priory Orchard Meadow".split()
_STREETS_DE = "Haupt Bahnhof Schiller Goethe Garten Linden Berg Kirch Schul Rosen Wald See Mozart Markt Mühlen Kaiser".split()
_STREETS_FR = ["de la République", "Victor Hugo", "des Lilas", "du Moulin", "Pasteur", "de la Gare", "Voltaire", "des Écoles", "Saint-Michel", "de l'Église", "Jean Jaurès"]
_STREETS_ES = ["Mayor", "de Alcalá", "Real", "de la Constitución", "Cervantes", "del Carmen", "de la Paz", "San Juan", "Goya", "de Colón"]


class Maker:
    """Invented values from a seed; ``known`` are name parts by kind."""

    def __init__(self, seed: int, known: dict[str, list[str]]) -> None:
        self.r = random.Random(seed)
        self.known = known

    def syllables(self, n: int) -> str:
        return "".join(self.r.choice(_ONSETS) + self.r.choice(_VOWELS) + self.r.choice(_CODAS) for _ in range(n))

    def given(self) -> str:
        if self.known.get("given") and self.r.random() < 0.6:
            return self.r.choice(self.known["given"])
        return (self.syllables(1) + self.r.choice(_GIVEN_ENDS)).capitalize()

    def family(self) -> str:
        if self.known.get("family") and self.r.random() < 0.6:
            return self.r.choice(self.known["family"])
        own = (self.syllables(1) + self.r.choice(_FAMILY_ENDS)).capitalize()
        if self.r.random() < 0.1:
            own += "-" + self.syllables(1).capitalize()
        return (self.r.choice(_PARTICLES) if self.r.random() < 0.28 else "") + own

    def known_name(self) -> str:
        """A name both parts of which are known."""
        if not (self.known.get("given") and self.known.get("family")):
            return self.name()
        how = self.r.random()
        given, family = self.r.choice(self.known["given"]), self.r.choice(self.known["family"])
        out = f"{family}, {given}" if how < 0.15 else f"{given} {family}"
        return out.lower() if how > 0.92 else out.upper() if how > 0.84 else out

    def name(self) -> str:
        r = self.r
        first = self.given() + ("-" + self.given() if r.random() < 0.15 else "")
        if r.random() < 0.12:
            first = first[0].upper() + "."
        elif r.random() < 0.12:
            first += f" {r.choice(string.ascii_uppercase)}."
        family = self.family()
        out = f"{family}, {first}" if r.random() < 0.13 and not first.endswith(".") else f"{first} {family}"
        how = r.random()
        return out.lower() if how < 0.1 else out.upper() if how < 0.18 else out

    def email(self) -> str:
        r = self.r
        g, f = (self.syllables(1) + r.choice(_GIVEN_ENDS), self.syllables(1) + r.choice(_FAMILY_ENDS))
        local = r.choice([f"{g}.{f}", f"{f}-{g}", f"{g}_{f}", f"{g[0]}.{f}", f"{f}{r.randint(2, 99)}", f"{g}{f[0]}", f"{g}.{f}+lists", f"{f}.{g}", g])
        host = r.choice(["post.example", "mail.example", "inbox.test", "firma.example", "lists.example.org", "uni.example.net", "corp.example.org", "correo.example.com", f"{self.syllables(2)}.example", "web.test"])
        how = r.random()
        if how < 0.7:
            out = f"{local}@{host}"
        elif how < 0.8:
            out = local + r.choice(["[at]", " [at] ", "(at)", " (at) ", " {at} ", " @ "]) + host
        elif how < 0.9:
            out = f"{local.replace('.', r.choice(['.', ' dot ']))} at {host.replace('.', ' dot ')}"
        else:
            at, dot = r.choice([(" AT ", " DOT "), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" {at} ", " {dot} "), ("{at}", "{dot}"), (" at ", " dot ")])
            out = local + at + host.replace(".", dot)
        return out.upper() if r.random() < 0.06 else out.title() if r.random() < 0.05 else out

    def digits(self, shape: str) -> str:
        return "".join(str(self.r.randint(0, 9)) if c == "9" else self.r.choice("ABCDEFGH") if c == "L" else c for c in shape)

    def phone(self) -> str:
        return self.digits(self.r.choice([
            "+99999999999", "+999999999999", "999.555.9999", "0499 999 999", "+61 499 999 999", "999 555 9999", "0044 20 9999 9999", "+44 (0)20 9999 9999", "(020) 9999-9999", "01.99.99.99.99", "+1-999-555-9999", "+1 999 555 9999",
            "1 (999) 555 9999", "+44 20 9999 9999", "020 9999 9999", "+49 30 99999999", "999-555-9999", "004930 99999999", "(999) 555-9999", "030/99999-999", "999/555-9999", "+33 1 99 99 99 99", "+49 (0)30 99999999", "01 99 99 99 99", "030 99999 999",
        ]))

    def id_number(self) -> str:
        r = self.r
        if r.random() < 0.6:
            return self.digits(r.choice([
                "999-99-9999", "999-99-9999", "999 99 9999", "LL 99 99 99 L", "LL999999L", "99999999L", "L9999999L", "99 999 999 999", "99999999999", "L99999999", "LL9999999", "LL999999", "999999999",
                "9 99 99 99 999 999 99", "756.9999.9999.99", "99/999/99999", "LLL99L99L999L", "99-9999999", "999.999.999-99", "99 999999 L 999", "L9999999",
            ]))
        sep = r.choice(["-", "-", ".", " ", ""])
        groups = ["9" * r.randint(2, 5) for _ in range(r.randint(2, 3))]
        shape = sep.join(groups)
        if r.random() < 0.5:
            shape = "L" * r.randint(1, 2) + r.choice([sep, ""]) + shape
        if r.random() < 0.4:
            shape += r.choice(["-", "", sep]) + r.choice("9L")
        shape += "9" * max(0, 6 - shape.count("9"))
        return self.digits(shape)

    def street(self, own: list[str]) -> str:
        """A street's own name: a usual one, or invented ones so that the words around it must tell."""
        if self.r.random() < 0.4:
            return self.r.choice(own)
        return self.syllables(self.r.randint(1, 2)).capitalize()

    def number(self) -> str:
        return str(self.r.randint(1, 320)) + (self.r.choice("abc") if self.r.random() < 0.12 else "")

    def address(self) -> str:
        r = self.r
        side = r.choice(["N ", "S ", "E ", "W ", "N. ", "West "]) if r.random() < 0.14 else ""
        head = r.choice(["", "", "", "", "Old ", "Great ", "Lower ", "Upper ", "North ", "St "])
        kind = r.choice(["Street", "Street", "Street", "Road", "Road", "Lane", "Ave", "Ave.", "Avenue", "Drive", "Dr", "Close", "Blvd", "Boulevard", "St.", "St", "Rd", "Rd.", "Court", "Way", "Place", "Square", "Terrace"])
        out = f"{self.number()} {side}{head}{self.street(_STREETS)} {kind}"
        how = r.random()
        return out.lower() if how < 0.2 else out.upper() if how < 0.23 else out

    def address_fr(self) -> str:
        r = self.r
        bis = r.choice([" bis", " ter", "bis"]) if r.random() < 0.25 else ""
        return f"{r.randint(1, 300)}{bis}{r.choice([' ', ' ', ', '])}{r.choice(['rue', 'rue', 'avenue', 'chemin', 'boulevard', 'place', 'impasse', 'Rue', 'quai'])} {self.street(_STREETS_FR)}"

    def address_es(self) -> str:
        r = self.r
        kind = r.choice(["Calle", "calle", "Calle", "Avenida", "Avda.", "Plaza", "Paseo", "Camino", "Ronda", "C/"])
        return f"{kind} {self.street(_STREETS_ES)}{r.choice([' ', ' ', ', ', ', ', ' nº ', ', nº ', ' n.º '])}{self.number()}"

    def address_de(self) -> str:
        r = self.r
        kind = r.choice(["straße", "straße", "straße", "str.", "strasse", "weg", "gasse", "allee", "platz", "ring", "ufer"])
        own = self.street(_STREETS_DE)
        how = r.random()
        if how < 0.12:
            return f"{r.choice(['Am', 'An der', 'Im', 'Zum'])} {own} {r.choice(['', 'Weg ', 'Platz '])}{self.number()}"
        if r.random() < 0.2:
            own = r.choice(["Alte-", "Neue-", "Obere-", "Groß-", "Klein-", self.syllables(1).capitalize() + "-", "North-", "Old-"]) + own
        name = f"{own}-{self.street(_STREETS_DE)}-{kind.capitalize()}" if how < 0.22 else f"{own}er {kind.capitalize()}" if how < 0.34 else own + kind
        return f"{name} {self.number()}"

    def ident(self) -> str:
        parts = ["".join(self.r.choice("bcdfglmnprstvwxz") + self.r.choice("aeiou") + self.r.choice("lmnrsx") for _ in range(1)) for _ in range(self.r.randint(2, 4))]
        return self.r.choice(["_".join(parts), parts[0] + "".join(p.capitalize() for p in parts[1:]), "".join(p.capitalize() for p in parts)])

    def other(self, slot: str) -> str:
        r = self.r
        return {
            "given": lambda: self.given(), "family": lambda: self.family(), "letter": lambda: r.choice(string.ascii_uppercase), "noun": lambda: r.choice(_NOUNS), "handle": lambda: self.given().lower() + str(r.randint(1, 99)),
            "num": lambda: str(r.choice([r.randint(1, 99), r.randint(100, 9999)])), "bignum": lambda: str(r.randint(100, 99999)), "ssn": lambda: self.digits("999 99 9999"), "part": lambda: self.digits("999-99-9999-L"), "ticket": lambda: "".join(r.choice(string.ascii_uppercase) for _ in range(r.randint(2, 5))) + "-" + "-".join(self.digits("9" * r.randint(2, 5)) for _ in range(r.randint(1, 2))), "thing": lambda: self.r.choice(_NOUNS_DE) if self.r.random() < 0.4 else self.syllables(r.randint(1, 3)).capitalize(), "isbn": lambda: self.digits("978-9-999-99999-9"), "order": lambda: f"20{r.randint(10, 24)}-" + self.digits("999-9999"),
            "epoch": lambda: str(r.randint(1262304000, 1719792000)), "date": lambda: f"20{r.randint(10, 24)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", "ip": lambda: f"{r.choice(['192.0.2', '198.51.100', '203.0.113'])}.{r.randint(1, 254)}", "port": lambda: str(r.randint(1000, 9999)),
            "version": lambda: f"{r.randint(0, 5)}.{r.randint(0, 20)}.{r.randint(0, 12)}", "ident": self.ident, "hash": lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice([8, 12, 32]))), "bigdigits": lambda: "".join(r.choice(string.digits) for _ in range(r.choice([8, 12]))), "word": lambda: r.choice(["bel", "dim", "ost", "zon", "ker", "wix"]),
        }[slot]()

    def fill(self, carrier: str) -> tuple[str, list[tuple[int, int, str]]]:
        """The sentence and its labelled spans."""
        makers = {"EMAIL": self.email, "PHONE": self.phone, "ID": self.id_number, "NAME": self.name, "KNOWN": self.known_name, "ADDRESS": self.address, "ADDRESS_FR": self.address_fr, "ADDRESS_ES": self.address_es, "ADDRESS_DE": self.address_de}
        text, spans, at = "", [], 0
        for m in re.finditer(r"\{([A-Za-z_]+)\}", carrier):
            text += carrier[at : m.start()]
            value = makers[m[1]]() if m[1] in makers else self.other(m[1])
            if m[1] in SLOT_TYPE:
                spans.append((len(text), len(text) + len(value), SLOT_TYPE[m[1]]))
            text, at = text + value, m.end()
        return text + carrier[at:], spans


def labelled_table(known: dict[str, list[str]], rounds: int = 10, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``rounds`` fillings of every carrier, each alone or between look-alikes, as (line, spans)."""
    make = Maker(seed, known)
    out = []
    for _ in range(rounds):
        for carrier in CARRIERS + LOOKALIKES:
            text, spans = make.fill(carrier)
            for front in (True, False):
                if make.r.random() < 0.4:
                    other = make.r.choice(LOOKALIKES) if make.r.random() < 0.7 else make.r.choice(CARRIERS)
                    extra, more = make.fill(other)
                    if front:
                        text, spans = f"{extra} {text}", more + [(a + len(extra) + 1, b + len(extra) + 1, t) for a, b, t in spans]
                    else:
                        text, spans = f"{text} {extra}", spans + [(a + len(text) + 1, b + len(text) + 1, t) for a, b, t in more]
            out.append((text, spans))
    return out
