import functools

import numpy as np

from signetry.operators import interventions as iv
from signetry.operators.laplacian import Solver, weighted_edges


def test_resistances_of_pairs_need_no_whole_sketch(spark, monkeypatch):
    """The driver may hold 8 of the 16 columns."""
    n = 12
    edges = spark.createDataFrame([(i, i + 1, 1) for i in range(n - 1)] + [(i, i + 5, -1) for i in range(0, n - 5, 2)], "source bigint, target bigint, sign int")
    conducting = weighted_edges(edges, 1.0, 0.1)
    u, v = np.array([0, 3, 10]), np.array([11, 9, 11])
    sketch = iv.resistance_sketch(conducting, Solver(conducting, n, grounded=True), 16)
    whole = ((sketch[u] - sketch[v]) ** 2).sum(1)
    monkeypatch.setattr(iv, "HELD", 8 * n)
    for held in (1_000, 0):
        solver = Solver(conducting, n, grounded=True, rtol=1e-10, dense=0, held=held)
        assert np.allclose(iv.pair_resistances(conducting, solver, u, v, 16, at_once=8 * n), whole, rtol=1e-6)


def test_global_baseline_beyond_a_whole_sketch(spark, monkeypatch):
    n = 12
    edges = spark.createDataFrame([(i, i + 1, 1) for i in range(n - 1)] + [(0, 5, -1), (2, 9, -1)], "source bigint, target bigint, sign int")
    values = spark.createDataFrame([(i, [float(i < 6), float(i % 3)]) for i in range(n)], "node_id bigint, value array<double>")
    whole = iv.global_baseline(edges, values, n, 10, 2).collect()
    monkeypatch.setattr(iv, "Solver", functools.partial(Solver, dense=0))
    monkeypatch.setattr(iv, "HELD", 64 * n)
    assert iv.global_baseline(edges, values, n, 10, 2).collect() == whole
