import numpy as np
import pytest

from signetry.operators import encoders as en


def _graph(n=60, m=200, seed=0, enemies=True):
    r = np.random.default_rng(seed)
    pairs = np.unique(np.sort(r.integers(0, n, (m, 2)), axis=1), axis=0)
    pairs = pairs[pairs[:, 0] < pairs[:, 1]]
    sign = np.where(r.random(len(pairs)) < 0.6, 1, -1 if enemies else 1)
    return np.column_stack([pairs, sign]), r.standard_normal((n, 4))


@pytest.mark.parametrize("layers,enemies", [(1, True), (2, True), (3, True), (2, False)])
def test_training_in_blocks_gives_the_same_states(layers, enemies):
    edges, x = _graph(enemies=enemies)
    config = en.EncoderConfig(4, 6, layers, 0.02, 25)
    whole = en.UndirectedSigned().fit(edges, len(x), x, config, 3)
    source, target, sign = (edges[:, k].astype(t) for k, t in ((0, np.int32), (1, np.int32), (2, np.int8)))
    assert np.abs(en.UndirectedSigned().fit_blocks(source, target, sign, len(x), x, config, 3, block=7) - whole).max() < 1e-8


def test_graphs_beyond_one_worker_are_trained(spark, monkeypatch):
    edges, x = _graph()
    config = en.EncoderConfig(4, 6, 2, 0.02, 10)
    table = spark.createDataFrame([tuple(map(int, r)) for r in edges], "source bigint, target bigint, sign int")
    features = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], en.STATE)
    monkeypatch.setattr(en, "BLOCK_EDGES", 50)
    got = en.UndirectedSigned().trained_states(table, features, config, [0, 1]).collect()
    assert len(got) == 2 * len(x)
    for seed in (0, 1):
        whole = en.UndirectedSigned().fit(edges, len(x), x, config, seed)
        found = {r["node_id"]: r["state"] for r in got if r["seed"] == seed}
        assert np.abs(np.array([found[i] for i in range(len(x))]) - whole).max() < 1e-8
