import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from signetry.operators import communities, encoders, interventions as iv, laplacian, polarization
from signetry.plans import measures

EDGES = "source bigint, target bigint, sign int"
CYCLE = [(0, 1, 1), (1, 2, -1), (2, 3, 1), (3, 0, 1)]
POINTS = [(1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.0, -1.0)]


def _coordinates(spark, points):
    return spark.createDataFrame([(i, list(p)) for i, p in enumerate(points)], "node_id bigint, value array<double>")


def _matrix(edges, n, eta):
    out = np.zeros((n, n))
    for u, v, s in edges:
        c = 1.0 if s > 0 else eta
        out[u, u] += c
        out[v, v] += c
        out[u, v] -= c
        out[v, u] -= c
    return out


def test_score_equals_the_pseudo_inverse(spark):
    edges, x = spark.createDataFrame(CYCLE, EDGES), np.array(POINTS)
    record = polarization.energy_components(edges, _coordinates(spark, POINTS), 4)
    pinv = np.linalg.pinv(_matrix(CYCLE, 4, 0.1))
    negative = _matrix([e for e in CYCLE if e[2] < 0], 4, 1.0)
    y = negative @ x
    structural, antagonistic = np.trace(x.T @ pinv @ x) / 2, np.trace(y.T @ pinv @ y) / 2
    assert record["structural_energy"] == pytest.approx(structural, abs=1e-8) and record["antagonistic_energy"] == pytest.approx(antagonistic, abs=1e-8)
    assert record["polarization"] ** 2 == pytest.approx(structural + 0.05 * antagonistic, abs=1e-8)
    assert polarization.score(structural, antagonistic, 0.0) ** 2 == pytest.approx(structural)
    with pytest.raises(ValueError):
        polarization.score(1.0, 1.0, -0.1)


def test_disconnected_graphs_raise(spark):
    with pytest.raises(ValueError, match="connected"):
        laplacian.check_nodes(spark.createDataFrame([(0, 1, 1), (2, 3, -1)], EDGES), 4)


def test_golden_energies_of_the_vector_graph(spark):
    rows = {r["dimension"]: r for r in measures.polarization_report(spark, "/root/testdata/sf0.01").collect()}
    assert rows[2]["num_edges"] == 8290 and rows[2]["negative_edges"] == 2758
    assert rows[2]["structural_energy"] == pytest.approx(11.63878871, abs=1e-6) and rows[2]["antagonistic_energy"] == pytest.approx(1682.83034764, abs=1e-4) and rows[2]["polarization"] == pytest.approx(9.78674134, abs=1e-6)
    assert rows[8]["structural_energy"] == pytest.approx(2.89659021, abs=1e-6) and rows[8]["polarization"] == pytest.approx(4.84696635, abs=1e-6)
    assert rows[2]["top_singular_value"] == pytest.approx(3.708969, abs=1e-5)


def test_all_solvers_agree(spark):
    r = random.Random(3)
    data = [(i, i + 1, 1) for i in range(29)] + [(*sorted(r.sample(range(30), 2)), r.choice([1, -1])) for _ in range(40)]
    edges = laplacian.weighted_edges(spark.createDataFrame(data, EDGES))
    x = np.random.default_rng(1).standard_normal((30, 2))
    x -= x.mean(0)
    want = np.linalg.pinv(_matrix(data, 30, 0.1)) @ x
    assert laplacian.Solver(edges, 30).solve(x) == pytest.approx(want, abs=1e-8)
    for held in (10_000, 0):
        assert laplacian.Solver(edges, 30, dense=0, held=held, rtol=1e-10).solve(x) == pytest.approx(want, abs=1e-6)
    dense, held = (laplacian.Solver(edges, 30, grounded=True, dense=d, rtol=1e-10).solve(x) for d in (100, 0))
    assert held == pytest.approx(dense, abs=1e-6) and dense[3] - dense[7] == pytest.approx(want[3] - want[7], abs=1e-8)
    with pytest.raises(laplacian.NotConverged):
        laplacian.Solver(edges, 30, dense=0, steps=1).solve(x)


def test_table_solver_agrees(spark):
    data = [(0, 1, 1), (1, 2, -1), (2, 3, 1), (3, 4, 1), (4, 0, 1)]
    x = np.random.default_rng(1).standard_normal((5, 1))
    x -= x.mean(0)
    edges = laplacian.weighted_edges(spark.createDataFrame(data, EDGES))
    got = laplacian.held_values(laplacian.solve_table(edges, _coordinates(spark, x.tolist())), 5)
    want = np.linalg.pinv(_matrix(data, 5, 0.1)) @ x
    assert got - got.mean(0) == pytest.approx(want, abs=1e-5)


def test_coordinates_have_unit_rows(spark):
    state = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(np.random.default_rng(0).standard_normal((4, 3)))], "node_id bigint, state array<double>")
    out, singular = polarization.opinion_coordinates(state, 2)
    assert all(sum(v * v for v in r["value"]) == pytest.approx(1) for r in out.collect()) and len(singular) == 2
    with pytest.raises(ValueError):
        polarization.opinion_coordinates(state, 4)


def test_er_baseline_needs_both_signs(spark):
    edges = spark.createDataFrame([(0, 1, 1), (1, 2, 1), (0, 2, -1)], EDGES)
    with pytest.raises(ValueError):
        polarization.er_baseline(edges, spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "node_id bigint, opinion double"), 3)
    assert polarization.er_baseline(edges, spark.createDataFrame([(0, -1.0), (1, 0.0), (2, 1.0)], "node_id bigint, opinion double"), 3) == pytest.approx(math.sqrt(2))


def test_rank_one_update_equals_recomputation(spark):
    path = [(0, 1, 1), (1, 2, 1), (2, 3, 1)]
    x = np.random.default_rng(2).standard_normal((4, 2))
    solve = lambda e: laplacian.Solver(laplacian.weighted_edges(spark.createDataFrame(e, EDGES)), 4, grounded=True)
    before, after = solve(path), solve([*path, (0, 2, 1)])
    w = before.solve(np.array([[1.0], [0], [-1], [0]]))[:, 0]
    assert iv.rank_one_update(before.solve(x), w, 0, 2, 1 + w[0] - w[2]) == pytest.approx(after.solve(x), abs=1e-10)
    with pytest.raises(ValueError):
        iv.rank_one_update(x, w, 0, 2, 0.0)


def test_greedy_lowers_the_energy(spark):
    edges = spark.createDataFrame([(i, (i + 1) % 12, 1 if i % 3 else -1) for i in range(12)], EDGES)
    coordinates = _coordinates(spark, [(math.cos(i), math.sin(i)) for i in range(12)])
    pool = iv.non_edges(12, edges, 30, 3)
    chosen = iv.greedy_order(edges, coordinates, pool, 6, 12)
    curve = [r["energy"] for r in iv.prefix_energies(edges, coordinates, chosen, [1, 2, 3, 4, 5, 6], 12).orderBy("budget").collect()]
    assert all(b <= a + 1e-12 for a, b in zip(curve, curve[1:])) and chosen.count() == 6
    assert iv.batched_greedy(edges, coordinates, pool, 6, 3, 12).count() == 6
    with pytest.raises(ValueError):
        iv.check_candidates(pool.unionByName(pool), 12)


def test_gray_zones_and_pool(spark):
    state = spark.createDataFrame([(i, [float(i // 2), float(i % 3), 1.0, float(i)]) for i in range(8)], "node_id bigint, state array<double>")
    labels = spark.createDataFrame([(i, i // 2) for i in range(8)], "node_id bigint, community int")
    coordinates, _ = polarization.opinion_coordinates(state, 2)
    gray = iv.gray_ranking(coordinates, labels, 1)
    assert gray.select("community_1", "community_2").distinct().count() == 6
    occupied = spark.createDataFrame([(2 * i, 2 * i + 1) for i in range(4)], "source bigint, target bigint")
    pool = iv.candidate_pool(gray, labels, occupied, 12, 17).collect()
    pairs = [(r["source"], r["target"]) for r in pool]
    assert len(set(pairs)) == 12 and not set(pairs) & {(0, 1), (2, 3), (4, 5), (6, 7)} and pairs != sorted(pairs)
    with pytest.raises(ValueError):
        iv.retained(labels, 3)


def test_augmentation_guards(spark):
    base = spark.createDataFrame([(0, 1, 1, 1.0)], EDGES + ", weight double")
    add = lambda *p: iv.augment(base, spark.createDataFrame(list(p), "source bigint, target bigint"))
    assert add((3, 2)).count() == 2
    for bad, message in ([((2, 3), (3, 2)), "duplicate"], [((2, 2),), "self-loop"], [((1, 0),), "exists"]):
        with pytest.raises(ValueError, match=message):
            add(*bad)
    with pytest.raises(ValueError):
        iv.non_edges(3, base, 5, 1)


def test_quota_of_batches():
    order = np.arange(6)
    codes, keys = np.array([0, 0, 0, 1, 1, 2]), np.array([1, 1, 2, 3, 4, 5])
    assert iv.batch_select(order, np.ones(6, bool), codes, np.zeros(3, int), 3, True, 0, 3, keys) == [0, 3, 5]
    assert iv.batch_select(order, np.ones(6, bool), codes, np.zeros(3, int), 3, False, 0, 3, keys) == [0, 2, 3]


def test_modularity_and_louvain_on_two_cliques(spark):
    data = [(i, j, 1) for b in (0, 5) for i in range(b, b + 5) for j in range(i + 1, b + 5)] + [(0, 5, -1), (1, 6, -1)]
    edges = spark.createDataFrame(data, EDGES)
    good = spark.createDataFrame([(i, i // 5) for i in range(10)], "node_id bigint, community bigint")
    q = communities.modularity(communities.layered(edges), good).first()[0]
    assert q == pytest.approx((1 - 0.5) + 0.5)
    member, quality = communities.local_louvain(data, list(range(10)), 1)
    assert quality == pytest.approx(q) and len({member[i] for i in range(5)}) == 1 and member[0] != member[5]
    runs = communities.louvain_runs(edges, [0, 1]).groupBy("seed").agg(F.countDistinct("community").alias("k")).collect()
    assert {r["k"] for r in runs} == {2}
    assert communities.local_louvain([], [3, 4], 0) == ({3: 0, 4: 1}, 0.0)


@pytest.mark.parametrize(
    ("counts", "k"),
    [((14, 14, 15, 16, 14, 15, 15, 14, 14, 14), 14), ((15, 18, 17, 16, 16, 14, 14, 17, 17, 16), 17), ((7, 7, 7, 7, 7, 6, 7, 6, 6, 7), 7), ((9, 9, 8, 8, 7, 7, 7, 7, 9, 9), 9), ((25, 23, 30, 25, 26, 25, 24, 24, 29, 24), 25)],
)
def test_first_most_frequent_count(spark, counts, k):
    assert communities.mode_first(spark.createDataFrame(list(enumerate(counts)), "position int, n int")).first()["n"] == k


def test_spectral_features_are_singular_vectors(spark):
    data = [(0, 1, 1), (1, 2, -1), (2, 3, 1), (0, 3, 1), (1, 3, -1)]
    edges = spark.createDataFrame(data, EDGES)
    dense = np.zeros((4, 4))
    for u, v, s in data:
        dense[u, v] = dense[v, u] = s
    _, values = encoders.spectral_features(edges, 4, 2)
    assert sorted(values) == pytest.approx(sorted(np.linalg.svd(dense)[1])[-2:], abs=1e-6)


def test_encoders_learn_and_are_reproducible(spark):
    data = [(i, j, 1 if i // 5 == j // 5 else -1) for i in range(10) for j in range(i + 1, 10) if (i + j) % 2]
    x = np.random.default_rng(0).standard_normal((10, 4))
    config = encoders.EncoderConfig(4, 4, 2, 0.05, 60)
    for kind in encoders.ENCODERS.values():
        a, b = (kind().fit(np.array(data), 10, x, config, 3) for _ in range(2))
        assert np.isfinite(a).all() and (a == b).all()
    with pytest.raises(ValueError):
        encoders.DirectedSigned().fit(np.array(data), 10, x, encoders.EncoderConfig(4, 8), 0)
