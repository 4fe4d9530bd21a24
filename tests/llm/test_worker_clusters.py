import numpy as np
from pyspark.sql import functions as F

from signetry.llm import spectral
from tests.llm.test_spectral import _found, _tables, _wide_groups


def test_hashes_are_sparks(spark):
    ids = [0, 1, -5, 2**40 + 3, 2**62]
    for k in (0, 3):
        theirs = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "id bigint").select(F.xxhash64("id", F.lit(k))).collect()]
        assert spectral._hashed(np.array(ids), k).tolist() == theirs


def test_workers_cluster_as_the_joins_do(spark):
    """Rings, stars and chains of several lengths, numbered at random, and two groups with a bridge."""
    rng = np.random.default_rng(2)
    pairs, at = [], 0
    for size in [2, 3, 5, 8, 13, 40] * 3:
        own = at + np.arange(size)
        pairs += [(own[0], v) for v in own[1:]] if size % 2 else list(zip(own, own[1:]))
        pairs += [tuple(rng.choice(own, 2, replace=False)) for _ in range(size)]
        at += size
    pairs += [(0, at - 1)]
    number = rng.permutation(at) * 7 - 100
    both = {(int(min(number[a], number[b])), int(max(number[a], number[b]))) for a, b in pairs}
    links = spark.createDataFrame([(a, b, float(w)) for (a, b), w in zip(sorted(both), rng.uniform(0.85, 1, len(both)))], "source bigint, target bigint, weight double")
    labels = spectral.component_labels(links).withColumnRenamed("node_id", "source")
    shown = lambda df: sorted(tuple(r) for r in df.select("node_id", "cluster_id", "closed").collect())
    for steps, rounds in ((12, 2), (3, 2), (12, 0)):
        assert shown(spectral._worker_clusters(links.join(labels, "source"), len(both), steps, rounds)) == shown(spectral._joined_clusters(links, steps, rounds))


def test_groups_over_several_leaves_and_heavy_components_are_whole(spark, monkeypatch):
    a, b, truth = _wide_groups(groups=60, singles=300, cosine=0.95)
    monkeypatch.setattr(spectral, "LEAF", 100)
    assert _found(spectral.node_clusters(*_tables(spark, a, b))) == truth
    monkeypatch.setattr(spectral, "HEAVY", 3)  # these go through joins
    assert _found(spectral.node_clusters(*_tables(spark, a, b))) == truth


def test_the_greatest_vector_of_a_node_counts(spark, monkeypatch):
    monkeypatch.setattr(spectral, "BLOCK", 3)
    rows = [(n, [float(v), 1.0] + [0.0] * 62, 0) for n in (1, 2) for v in (1, 3, 2, 3, 0, 1)]
    table = _tables(spark, rows, [(n, [1.0] + [0.0] * 7, 0) for n in (1, 2, 3)])
    got = {r["node_id"]: r["z"][:2] for r in spectral.unit_vectors(*table).collect()}
    assert set(got) == {1, 2} and all(np.allclose(v, np.array([3, 1]) / np.sqrt(10)) for v in got.values())
