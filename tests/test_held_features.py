import numpy as np

from signetry.operators import encoders


def test_features_of_held_edges_send_no_vectors(spark, monkeypatch):
    edges = spark.createDataFrame([(i, (i * 5 + 1) % 40, 1 if i % 3 else -1) for i in range(40) if i != (i * 5 + 1) % 40], "source bigint, target bigint, sign int")
    _, whole = encoders.spectral_features(edges, 40, 3)
    monkeypatch.setattr(encoders, "DENSE", 0)
    monkeypatch.setattr(encoders, "_multiplier", lambda *a: 1 / 0)
    state, values = encoders.spectral_features(edges, 40, 3, rounds=2_000)
    assert state.count() == 40 and np.allclose(values, whole, rtol=1e-3)


def test_features_by_one_worker_hold_nothing_on_the_driver(spark, monkeypatch):
    """Rows are decomposed in blocks; vectors span what those of the whole matrix do."""
    edges = spark.createDataFrame([(i, (i * 5 + 1) % 40, 1 if i % 3 else -1) for i in range(40) if i != (i * 5 + 1) % 40], "source bigint, target bigint, sign int")
    held = lambda state: np.array([r["state"] for r in state.orderBy("node_id").collect()])
    state, whole = encoders.spectral_features(edges, 40, 4)
    one = held(state)
    monkeypatch.setattr(encoders, "DENSE", 0)
    monkeypatch.setattr(encoders, "QR_ROWS", 15)
    monkeypatch.setattr(encoders, "FEATURE_ROWS", 7)
    for name in ("_multiplier", "_held_multiplier", "HELD"):
        monkeypatch.setattr(encoders, name, None)
    state, values = encoders.spectral_features(edges, 40, 4, rounds=2_000)
    other = held(state)
    assert np.allclose(values, whole, rtol=1e-6) and np.allclose(one @ one.T, other @ other.T, atol=1e-3)
