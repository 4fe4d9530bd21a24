import numpy as np
import pytest

from signetry.operators import laplacian, polarization


def test_workers_give_the_energies_of_the_factored_matrix(spark, monkeypatch):
    rng = np.random.default_rng(2)
    pairs = {(i, i + 1) for i in range(59)} | {tuple(sorted(map(int, rng.choice(60, 2, replace=False)))) for _ in range(90)}
    edges = spark.createDataFrame([(a, b, 1 if (a + b) % 3 else -1) for a, b in sorted(pairs)], "source bigint, target bigint, sign int")
    state = spark.createDataFrame([(i, rng.standard_normal(12).tolist()) for i in range(60)], "node_id bigint, state array<double>")
    whole = [r.asDict() for r in polarization.sensitivity(edges, state, 8).collect()]
    for module in (laplacian, polarization):
        monkeypatch.setattr(module, "DENSE", 10)
    monkeypatch.setattr(polarization, "held_values", None)  # no vector reaches the driver
    monkeypatch.setattr(polarization, "energy_table", None)
    for one, other in zip(whole, (r.asDict() for r in polarization.sensitivity(edges, state, 8).collect()), strict=True):
        assert one["variant"] == other["variant"] and one["k"] == other["k"]
        assert [one[k] for k in list(one)[2:]] == pytest.approx([other[k] for k in list(other)[2:]], rel=1e-6)
