import random

import pytest
from pyspark.sql import functions as F

from signetry.operators import components, events, splits
from signetry.operators.ranking import global_rank

EDGES = "source bigint, target bigint, sign int"


def _raw(spark, data):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "line_no bigint, source string, target string, weight string, timestamp bigint")


def test_blank_endpoints_and_zero_weights_are_no_events(spark):
    built = events.build_events(_raw(spark, [("", "bob", "1", 1), ("alice", "bob", "2", 2), ("a", "b", "0", 3), ("c", "c", "1", 4), ("d", "e", "x", 5), (None, "e", "1", 6)]), temporal=True)
    assert [(r["event_id"], r["source"], r["target"], r["sign"]) for r in built.collect()] == [(0, 0, 1, 1)]


def test_static_duplicates_keep_the_last_direction(spark):
    raw = spark.createDataFrame([(0, "10", "20", 1.0), (1, "20", "10", -1.0)], "line_no bigint, source string, target string, weight double")
    built = events.build_events(raw, temporal=False).collect()
    assert len(built) == 1 and built[0]["weight"] == -1.0 and (built[0]["source"], built[0]["target"]) == (0, 1)


def test_temporal_logs_keep_every_event_in_order(spark):
    built = events.build_events(_raw(spark, [("a", "b", "1", 5), ("b", "a", "-1", 3), ("c", "a", "1", 5)]), temporal=True)
    assert [(r["source"], r["target"], r["sign"]) for r in built.orderBy("event_id").collect()] == [(0, 1, -1), (1, 0, 1), (2, 1, 1)]


def test_fingerprints_ignore_order_but_not_signs(spark):
    data = [(0, 1, 1), (1, 2, -1), (2, 3, 1)]
    one = spark.createDataFrame(data, EDGES)
    two = spark.createDataFrame([(t, s, w) for s, t, w in reversed(data)], EDGES)
    other = spark.createDataFrame([(0, 1, 1), (1, 2, 1), (2, 3, 1)], EDGES)
    f = lambda df: events.fingerprint(df).first()["fingerprint"]
    assert f(one) == f(two) != f(other)
    assert events.fingerprint_bytes(one, 4) == events.fingerprint_bytes(two, 4) != events.fingerprint_bytes(other, 4)
    assert events.fingerprint(one.limit(0)).first()["n_edges"] == 0


@pytest.mark.parametrize("local", [0, 10**6])
def test_components_of_random_graphs(spark, monkeypatch, local):
    monkeypatch.setattr(components, "LOCAL_EDGES", local)
    r = random.Random(4)
    data = [(r.randint(0, 300), r.randint(0, 300), 1) for _ in range(180)] + [(i, i + 1, 1) for i in range(1000, 1100)] + [(None, 5, 1), (7, 7, 1)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for s, t, _ in data:
        if s is not None and s != t:
            a, b = find(s), find(t)
            parent[max(a, b)] = min(a, b)
    got = {x["node_id"]: x["component"] for x in components.component_labels(spark.createDataFrame(data, EDGES)).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert components.component_labels(spark.createDataFrame([], EDGES)).count() == 0


def test_connectivity_counts_isolated_ids(spark):
    path = spark.createDataFrame([(0, 1, 1), (1, 2, 1)], EDGES)
    assert components.is_connected(path, 3) and not components.is_connected(path, 4) and not components.is_connected(path, 0)


def test_split_keeps_train_connected(spark):
    r = random.Random(1)
    pairs = {(i, i + 1) for i in range(59)} | {tuple(sorted(r.sample(range(60), 2))) for _ in range(300)}
    edges = spark.createDataFrame([(i, s, t, 1) for i, (s, t) in enumerate(sorted(pairs))], "event_id bigint, source bigint, target bigint, sign int")
    out = splits.split_snapshot(edges, seed=3)
    n = len(pairs)
    assert {x["split"]: x["n"] for x in out.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()} == {"train": round(0.7 * n), "val": round(0.15 * n), "test": n - round(0.7 * n) - round(0.15 * n)}
    splits.check_splits(out, 60)
    assert components.spanning_tree(edges).count() == 59
    tree = spark.createDataFrame([(i, i, i + 1, 1) for i in range(10)], "event_id bigint, source bigint, target bigint, sign int")
    with pytest.raises(ValueError):
        splits.split_snapshot(tree)


def test_global_rank_equals_a_sort(spark):
    r = random.Random(2)
    data = [(r.randint(0, 50), i) for i in range(500)]
    got = {(x["a"], x["b"]): x["k"] for x in global_rank(spark.createDataFrame(data, "a int, b int"), ["a", "b"], "k").collect()}
    assert got == {p: k for k, p in enumerate(sorted(data))}


def test_missing_events_raise(spark):
    pairs = spark.createDataFrame([(0, 1, 1), (2, 3, 1)], EDGES)
    log = spark.createDataFrame([(1, 0, 1, 5.0, 9)], "source bigint, target bigint, sign int, weight double, event_id bigint")
    out = events.restore_direction(pairs, log, ["event_id"])
    assert {tuple(r) for r in out.collect()} == {(1, 0, 1, 5.0, 9), (None, None, 1, None, None)}
    with pytest.raises(Exception, match="a pair has no event"):
        events.check_restored(out).collect()
