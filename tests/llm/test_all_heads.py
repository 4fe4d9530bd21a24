import inspect

import numpy as np
import pytest

from signetry.llm import spectral


@pytest.mark.parametrize("block", [60, 10_000])
def test_all_similar_pairs_are_linked_whatever_the_number(spark, monkeypatch, block):
    monkeypatch.setattr(spectral, "BLOCK", block)
    monkeypatch.setattr(spectral, "LEAST", 40)
    monkeypatch.setattr(spectral, "TILE", 16)
    rng = np.random.default_rng(4)
    a, b = rng.standard_normal((900, 64)) * 0.07, rng.standard_normal((900, 8))
    a += rng.standard_normal((30, 64))[rng.integers(0, 30, 900)]
    b[:150] = b[0]  # one place of the tree for many
    z = np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b)]).astype(np.float32)
    nodes = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(z)], "node_id bigint, z array<float>")
    wide = z.astype(float)
    least = np.minimum(wide[:, :64] @ wide[:, :64].T, wide[:, 64:] @ wide[:, 64:].T)
    truth = {(i, j) for i, j in zip(*np.nonzero(least >= 0.85)) if i < j}
    rows = [(r["source"], r["target"]) for r in spectral._block_links(nodes, 900, (64, 8), 0.85).collect()]
    assert len(truth) > 100 and len(rows) == len(set(rows)) and set(rows) == truth


def test_no_number_of_nodes_switches_the_comparison():
    for f in (spectral.affinity_links, spectral.spectral_clusters):
        assert inspect.signature(f).parameters["exact"].default is None
