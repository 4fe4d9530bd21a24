import itertools

import pytest

from signetry import pipeline
from signetry.operators import communities


def test_graphs_beyond_one_worker_get_communities(spark, monkeypatch):
    cliques = [[(a + 6 * c, b + 6 * c, 1) for a, b in itertools.combinations(range(6), 2)] for c in range(3)]
    data = sum(cliques, []) + [(0, 6, -1), (6, 12, -1), (0, 12, -1)]
    edges = spark.createDataFrame(data, "source bigint, target bigint, sign int")
    monkeypatch.setattr(communities, "LOCAL_EDGES", 10)
    rows = communities.louvain_runs(edges, [0]).collect()
    home = {r["node_id"]: r["community"] for r in rows}
    assert len(home) == 18 and len({home[6 * c] for c in range(3)}) == 3 and all(home[i] == home[i - i % 6] for i in home)
    quality = communities.local_louvain(data, list(range(18)), 0)[1]
    assert all(r["modularity"] == pytest.approx(quality) for r in rows)
    assert pipeline.estimate_k(edges, 5, [0]) == 3
