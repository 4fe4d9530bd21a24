import numpy as np
import pytest

from signetry.llm.spectral import _usable, describe, mutual_groups, node_clusters, unit_vectors

E, O = "node_id bigint, node_embeddings array<float>, extra int", "node_id bigint, opinion_coordinates array<double>, node_embeddings int"


def _tables(spark, a, b):
    return spark.createDataFrame(a, E), spark.createDataFrame(b, O)


def _blobs(seed=0, sizes=(8, 6, 5, 4, 60), singles=120):
    rng = np.random.default_rng(seed)
    a, b, truth, node = [], [], {}, 0
    for size in sizes:
        x, y = rng.standard_normal(64), rng.standard_normal(8)
        x, y = x / np.linalg.norm(x), y / np.linalg.norm(y)
        members = list(range(node, node + size))
        for n in members:
            a.append((n, [float(v) for v in (x + 0.012 * rng.standard_normal(64)) * rng.uniform(0.5, 3)], 1))
            b.append((n, [float(v) for v in y + 0.03 * rng.standard_normal(8)], 1))
            if size >= 5:
                truth[n] = members[0]
        node += size
    for n in range(node, node + singles):
        a.append((n, [float(v) for v in rng.standard_normal(64)], 1))
        b.append((n, [float(v) for v in rng.standard_normal(8)], 1))
    return a, b, truth


def test_groups_are_found_exactly(spark):
    a, b, truth = _blobs()
    dirty = [(None, [1.0] * 64, 0), (900, None, 0), (901, [], 0), (902, [1.0] * 63, 0), (903, [0.0] * 64, 0), (904, [float("nan")] * 64, 0), (905, [None] + [1.0] * 63, 0), (906, [1.0] * 64, 0)]
    emb, op = _tables(spark, a + dirty + a[:7], b + [(n, [1.0] * 8, 0) for n in range(900, 906)])
    clusters = node_clusters(emb, op)
    assert {r["node_id"]: r["cluster_id"] for r in mutual_groups(clusters).collect()} == truth
    top = describe(clusters).where("cluster_id = 0").orderBy("typical_rank").collect()
    assert [r["typical_rank"] for r in top] == [1, 2, 3] and {r["size"] for r in top} == {8}
    assert top[0]["affinity"] >= top[1]["affinity"] >= top[2]["affinity"] > 0.85


def test_chains_that_are_not_mutual_are_no_group(spark):
    angles = np.radians(np.arange(0, 120, 12))
    a = [(i, [float(np.cos(t)), float(np.sin(t))] + [0.0] * 62, 1) for i, t in enumerate(angles)]
    b = [(i, [1.0] + [0.0] * 7, 1) for i in range(len(angles))]
    emb, op = _tables(spark, a, b)
    found = mutual_groups(node_clusters(emb, op)).collect()
    by = {}
    for r in found:
        by.setdefault(r["cluster_id"], []).append(r["node_id"])
    for members in by.values():
        assert np.cos(angles[max(members)] - angles[min(members)]) >= 0.85


def test_exact_copies_form_one_group_without_all_pairs(spark):
    a = [(i, [1.0, 2.0] + [0.5] * 62, 1) for i in range(3000)]
    b = [(i, [0.5] * 8, 1) for i in range(3000)]
    out = mutual_groups(node_clusters(*_tables(spark, a, b)))
    assert out.count() == 3000 and out.select("cluster_id").distinct().collect()[0][0] == 0


def test_empty_tables(spark):
    emb, op = _tables(spark, [], [])
    clusters = node_clusters(emb, op)
    assert clusters.count() == 0 and mutual_groups(clusters).count() == 0 and describe(clusters).count() == 0


def test_unit_vectors_have_unit_length(spark):
    emb, op = _tables(spark, [(1, [1e30] * 64, 0)], [(1, [3.0] + [0.0] * 7, 0)])
    z = unit_vectors(emb, op).first()["z"]
    assert sum(x * x for x in z[:64]) == pytest.approx(1, abs=1e-5) and z[64] == pytest.approx(1)
    assert _usable(emb, "node_embeddings", 8).count() == 0


def _wide_groups(groups=100, singles=1500, cosine=0.86, seed=5):
    """Groups of five whose members have just this cosine, two by two, in both vectors."""
    rng = np.random.default_rng(seed)
    a, b, truth = [], [], {}
    for g in range(groups):
        for rows, width in ((a, 64), (b, 8)):
            q, _ = np.linalg.qr(rng.standard_normal((width, 6)))
            rows += [(5 * g + i, (np.sqrt(cosine) * q[:, 5] + np.sqrt(1 - cosine) * q[:, i]).tolist(), 1) for i in range(5)]
        truth |= {5 * g + i: 5 * g for i in range(5)}
    for n in range(5 * groups, 5 * groups + singles):
        a.append((n, rng.standard_normal(64).tolist(), 1))
        b.append((n, rng.standard_normal(8).tolist(), 1))
    return a, b, truth


def _found(clusters):
    return {r["node_id"]: r["cluster_id"] for r in mutual_groups(clusters).collect()}


@pytest.mark.parametrize("exact", [None, 0])
def test_groups_just_above_the_limit_are_whole(spark, monkeypatch, exact):
    from signetry.llm import spectral

    monkeypatch.setattr(spectral, "BLOCK", 300)
    a, b, truth = _wide_groups()
    assert _found(node_clusters(*_tables(spark, a, b), exact=exact)) == truth


def test_the_power_steps_and_the_rounds_decide(spark):
    """Without the walk, or without k-means, groups are lost."""
    a, b, truth = _wide_groups(groups=150, singles=100, cosine=0.9)
    tables = _tables(spark, a, b)
    assert _found(node_clusters(*tables)) == truth
    assert _found(node_clusters(*tables, steps=0)) != truth
    assert _found(node_clusters(*tables, steps=2)) != truth
    assert _found(node_clusters(*tables, rounds=0)) != truth


def test_damping_keeps_what_stays_and_shrinks_the_rest():
    from signetry.llm.spectral import SLOWEST, _damping

    for value, limit in ((1.0, None), (SLOWEST, 1e-5), (0.3, 1e-5), (0.0, 1e-5)):
        now, before = 1.0, 0.0
        for a, b in _damping(12):
            now, before = a * (2 / SLOWEST * value * now - now) + b * before, now
        assert abs(now - 1) < 1e-9 if limit is None else abs(now) < limit


def test_a_group_with_a_link_to_outside_is_no_closed_cluster(spark):
    """Two tight groups, a bridge between two of their nodes: no cut through the bridge counts as a group."""
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.standard_normal((64, 4)))
    turn = np.radians(25)
    centres = [q[:, 0], np.cos(2 * turn) * q[:, 0] + np.sin(2 * turn) * q[:, 1]]
    a = [(10 * g + i, (centres[g] + 0.01 * rng.standard_normal(64)).tolist(), 1) for g in range(2) for i in range(6)]
    a.append((30, (np.cos(turn) * q[:, 0] + np.sin(turn) * q[:, 1]).tolist(), 1))
    b = [(n, [1.0] + [0.0] * 7, 1) for n, _, _ in a]
    assert _found(node_clusters(*_tables(spark, a, b))) == {}
    assert set(_found(node_clusters(*_tables(spark, a[:-1], b[:-1]))).values()) == {0, 10}


def test_blocks_of_a_broad_cluster_refute_it(spark, monkeypatch):
    from signetry.llm import spectral

    monkeypatch.setattr(spectral, "PAIR_BLOCK", 3)
    angles = np.radians(np.linspace(0, 40, 12))
    z = [(i, 7, True, [float(np.cos(t)), float(np.sin(t))] + [0.0] * 62 + [1.0] + [0.0] * 7) for i, t in enumerate(angles)]
    rows = spark.createDataFrame(z, "node_id bigint, cluster_id bigint, closed boolean, z array<float>")
    assert [r[0] for r in spectral._broken_clusters(rows.select("cluster_id", "node_id", "z"), (64, 8), 0.85).collect()] == [7]
    assert mutual_groups(rows).count() == 0 and mutual_groups(rows.where("node_id < 8")).count() == 8
