import random

import numpy as np
import pytest

from signetry.llm import packing
from signetry.llm.packing import LengthIndex, fills, pack, pack_all, patterns


def test_patterns_use_every_item_once_and_never_overflow():
    r = random.Random(4)
    for capacity in (7, 50, 200):
        for _ in range(20):
            counts = np.zeros(capacity + 1, int)
            for _ in range(r.randint(0, 200)):
                counts[r.randint(1, capacity)] += 1
            used = np.zeros(capacity + 1, int)
            for pattern, times in patterns(counts, capacity):
                assert times >= 1 and sum(k * n for k, n in pattern.items()) <= capacity
                for length, copies in pattern.items():
                    used[length] += copies * times
            assert (used == counts).all()


def test_exact_complements_of_one_two_and_three():
    index = LengthIndex(np.bincount([3, 5, 5, 11], minlength=31))
    free = index.counts
    assert index.exact(11, free) == (11,) and sorted(index.exact(10, free)) == [5, 5] and sorted(index.exact(13, free)) == [3, 5, 5]
    assert index.exact(6, free) is None and index.exact(22, free) is None and index.exact(30, free) is None


def test_assignment(spark):
    r = random.Random(9)
    sizes = [(i, r.choice([7, 7, 7, r.randint(1, 40), r.randint(1, 250)])) for i in range(800)] + [(900, 0), (901, None), (902, 100), (903, 101), (3, 7)]
    df = spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint")
    out = [r.asDict() for r in pack(df, 100).collect()]
    for i, n in sizes:
        parts = [x for x in out if x["doc_id"] == i]
        if not n:
            assert [(p["part"], p["n_tokens"], p["container_id"]) for p in parts] == [(0, 0, None)]
        elif i != 3:
            assert sum(p["n_tokens"] for p in parts) == n and len(parts) == -(-n // 100)
    load = {}
    for x in out:
        if x["container_id"] is not None:
            load[x["container_id"]] = load.get(x["container_id"], 0) + x["n_tokens"]
    assert max(load.values()) <= 100 and sorted(load) == list(range(len(load)))
    assert sum(load.values()) / (100 * len(load)) > 0.98


def test_hot_length_is_ranked_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_BLOCK", 50)
    df = spark.createDataFrame([(i, 10) for i in range(1000)], "doc_id bigint, n_tokens bigint")
    load = pack(df, 100).groupBy("container_id").count().collect()
    assert len(load) == 100 and {r["count"] for r in load} == {10}


def test_empty_table_and_several_kinds(spark):
    df = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    assert pack(df, 10).count() == 0
    with pytest.raises(ValueError):
        pack(df, 0)
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 12)], "doc_id bigint, n_tokens bigint")
    all_ = pack_all(df, {"a": 10, "b": 20})
    assert {(r["container_name"], r["fill"]) for r in fills(all_).collect()} == {("a", 1.0), ("a", 0.2), ("b", 0.85), ("b", 0.25)} or fills(all_).count() in (4, 5)
