import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from signetry.operators import interventions as iv
from signetry.operators.systems import WorkerSystems, hashed_words


@pytest.fixture(scope="module")
def problem(spark):
    rng = np.random.default_rng(4)
    n = 60
    pairs = {(i, i + 1) for i in range(n - 1)} | {tuple(sorted(map(int, rng.choice(n, 2, replace=False)))) for _ in range(90)}
    edges = spark.createDataFrame([(a, b, 1 if (a + b) % 3 else -1) for a, b in sorted(pairs)], "source bigint, target bigint, sign int")
    values = spark.createDataFrame([(i, rng.standard_normal(5).tolist()) for i in range(n) if i != 7], "node_id bigint, value array<double>")
    pool = iv.non_edges(n, edges, 40, "3").withColumns({"community_1": F.col("source") % 2, "community_2": F.col("target") % 2 + 2})
    return edges, values, pool, n


def _by_workers(monkeypatch):
    monkeypatch.setattr(iv, "DENSE", 10)
    for name in ("Solver", "held_values", "pair_resistances"):  # no vector reaches the driver
        monkeypatch.setattr(iv, name, None)


def test_signs_are_those_of_spark(spark):
    rows = [(0, 1), (5, 2**31 - 1), (77, 123_456)]
    found = spark.createDataFrame(rows, "s bigint, t bigint").select(F.xxhash64(F.lit(2026), "s", "t", F.lit(1)).alias("h")).collect()
    own = hashed_words(np.array([r[0] for r in rows], np.int32), np.array([r[1] for r in rows], np.int32), 2026, 1)
    assert [r["h"] for r in found] == own.view(np.int64).tolist()


def test_batches_by_workers_are_those_of_the_factored_matrix(problem, monkeypatch):
    whole = iv.batched_greedy(*problem[:3], 9, 3, problem[3], equal=True).collect()
    _by_workers(monkeypatch)
    assert iv.batched_greedy(*problem[:3], 9, 3, problem[3], equal=True).collect() == whole and len(whole) == 9


def test_curve_by_workers_is_that_of_the_factored_matrix(problem, monkeypatch):
    edges, values, pool, n = problem
    chosen = pool.limit(6).withColumn("selection_step", F.row_number().over(Window.orderBy("sample_rank")))
    curve = lambda: [tuple(r) for r in iv.prefix_energies(edges, values, chosen, [2, 5, 6], n).orderBy("budget").collect()]
    whole = curve()
    _by_workers(monkeypatch)
    for one, other in zip(whole, curve(), strict=True):
        assert one == pytest.approx(other, rel=1e-6, abs=1e-6)
    assert whole[0][1] > whole[1][1] > whole[3][1]


def test_order_by_workers_is_that_of_the_factored_matrix(problem, monkeypatch):
    """The second case solves for two candidates at a time, so that choices after the first need further ones."""
    edges, values, pool, n = problem
    whole = iv.greedy_order(edges, values, pool, 12, n).collect()
    _by_workers(monkeypatch)
    assert iv.greedy_order(edges, values, pool, 12, n).collect() == whole and len(whole) == 12
    monkeypatch.setattr(WorkerSystems, "ahead", lambda self, wanted: 2)
    assert iv.greedy_order(edges, values, pool, 4, n).collect() == whole[:4]


def test_global_baseline_by_workers(problem, monkeypatch):
    edges, values, _, n = problem
    whole = iv.global_baseline(edges, values, n, 30, 5).collect()
    _by_workers(monkeypatch)
    assert iv.global_baseline(edges, values, n, 30, 5).collect() == whole and len(whole) == 5
