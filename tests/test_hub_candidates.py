from signetry.operators import communities
from signetry.operators.events import hop_neighbours


def test_candidates_make_no_pairs_of_a_hubs_enemies(spark, rows, monkeypatch):
    edges = spark.createDataFrame([(0, i, -1) for i in range(1, 9)] + [(8, 9, -1), (9, 10, 1), (3, 11, 1)], "source bigint, target bigint, sign int")
    partition = spark.createDataFrame([(i, i % 4) for i in range(11)], "node_id bigint, community int")
    home = dict(rows(partition))
    for hops in (1, 2, 3):
        near = {(r["node_id"], home[r["other"]]) for r in hop_neighbours(edges, hops).collect() if r["other"] in home}
        assert set(rows(communities.candidate_communities(edges, partition, hops))) == near | set(home.items())
    monkeypatch.setattr(communities, "hop_neighbours", lambda *a: 1 / 0, raising=False)
    communities.candidate_communities(edges, partition).count()


def test_move_gains_make_no_pairs_of_a_hubs_enemies(spark, rows, monkeypatch):
    edges = spark.createDataFrame([(0, i, -1) for i in range(1, 5)] + [(1, 2, 1)], "source bigint, target bigint, sign int")
    partition = spark.createDataFrame([(i, i % 2) for i in range(5)], "node_id bigint, community int")
    monkeypatch.setattr(communities, "hop_neighbours", lambda *a: 1 / 0, raising=False)
    gains = {(n, c): g for n, c, g in rows(communities.move_gains(edges, partition))}
    assert len(gains) == 10 and all(abs(gains[i, i % 2]) < 1e-12 for i in range(5))
