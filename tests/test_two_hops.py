import random

from pyspark.sql import DataFrame

from signetry.operators import events


def test_workers_reach_what_the_joins_do(spark, rows, monkeypatch):
    """A hub with many enemies, random signs (none, 0 and null too), a loop and repeated edges."""
    random.seed(3)
    edges = [(7, 100 + i, -1) for i in range(40)] + [(random.randrange(60), random.randrange(60), random.choice([-2, -1, 0, 1, None])) for _ in range(90)] + [(5, 5, -1), (5, 6, -1), (5, 6, 1)]
    df = spark.createDataFrame(edges, "source bigint, target bigint, sign int")
    monkeypatch.setattr(events, "HOP_ROWS", 50)
    with monkeypatch.context() as m:
        m.setattr(DataFrame, "join", None)  # makes no pairs
        found = rows(events.hop_neighbours(df))
    monkeypatch.setattr(events, "HOP_EDGES", 0)
    assert found == rows(events.hop_neighbours(df)) and len(found) > 1700
    assert rows(events.hop_neighbours(df.limit(0))) == []


def test_numbered_nodes_reach_by_workers_beyond_what_the_driver_numbers(spark, rows, monkeypatch):
    """More edges than HOP_EDGES; node 3 has none, its place stays empty."""
    random.seed(5)
    pairs = [tuple(random.choice([x for x in range(60) if x != 3]) for _ in range(2)) for _ in range(150)]
    df = spark.createDataFrame([(a, b, random.choice([-1, 0, 1, None])) for a, b in pairs], "source bigint, target bigint, sign int")
    monkeypatch.setattr(events, "HOP_EDGES", 0)
    whole = rows(events.hop_neighbours(df))
    monkeypatch.setattr(events, "HOP_EDGES", 40)
    monkeypatch.setattr(DataFrame, "join", None)  # makes no pairs
    assert rows(events.hop_neighbours(df)) == whole and len(whole) > 300
    monkeypatch.setattr(events, "HOP_EDGES", 150)
    far = df.select((df.source + 10**12).alias("source"), (df.target + 10**12).alias("target"), "sign")
    assert rows(events.hop_neighbours(far)) == [(a + 10**12, b + 10**12, d) for a, b, d in sorted(whole, key=lambda r: tuple((x is None, str(x + 10**12)) for x in r[:2]))]
