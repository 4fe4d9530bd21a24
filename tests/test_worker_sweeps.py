import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from signetry.operators import communities


def _graph(seed: int, n: int = 60, loops: bool = False) -> list[tuple[int, int, int, float]]:
    r = random.Random(seed)
    pairs = {tuple(sorted((r.randrange(n), int(n * r.random() ** 3)))) for _ in range(3 * n)}
    return [(3 * a, 3 * b, r.choice([1, -1, -1]), float(r.randint(1, 3))) for a, b in sorted(pairs) if loops or a != b]


@pytest.mark.parametrize("seed,hub,loops", [(0, 64, False), (1, 0, False), (2, 4, True)])
def test_sweeps_in_a_worker_move_as_the_joins_do(spark, monkeypatch, seed, hub, loops):
    edges = spark.createDataFrame(_graph(seed, loops=loops), "source bigint, target bigint, sign int, weight double")
    nodes = edges.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()
    monkeypatch.setattr(communities, "SWEEP_EDGES", 0)
    joined = sorted(map(tuple, communities.sweep_communities(edges, nodes, sweeps=6, seed=seed).collect()))
    monkeypatch.setattr(communities, "SWEEP_EDGES", 10**6)
    monkeypatch.setattr(communities, "HUB", hub)
    assert sorted(map(tuple, communities.sweep_communities(edges, nodes, sweeps=6, seed=seed).collect())) == joined
    assert len({c for _, c in joined}) < len(joined)


def test_the_enemies_of_a_hub_cost_no_square_of_them(spark):
    n = 20_000
    edges = spark.createDataFrame([(0, i, -1) for i in range(1, n)] + [(i, i + 1, 1) for i in range(1, n - 1, 2)], "source bigint, target bigint, sign int")
    nodes = spark.range(n).withColumnRenamed("id", "node_id")
    began = time.time()
    assert communities.sweep_communities(edges, nodes, sweeps=2).count() == n
    assert time.time() - began < 60


def test_hubs_and_plain_lists_give_the_same_moves(monkeypatch):
    rows = np.array([r[:3] for r in _graph(5, 400)])
    n = int(rows[:, :2].max()) + 1
    ways = [np.random.default_rng(k).integers(0, 2, n) for k in range(3)]
    out = []
    for hub in (0, 10, 10**9):
        monkeypatch.setattr(communities, "HUB", hub)
        out.append(communities._Swept(n, rows[:, 0], rows[:, 1], rows[:, 2] > 0, np.ones(len(rows))).run(ways, 6, 1e-7))
    assert (out[0] == out[1]).all() and (out[0] == out[2]).all()


def test_nodes_without_edges_stay_alone(spark):
    edges = spark.createDataFrame([], "source bigint, target bigint, sign int")
    nodes = spark.range(5).withColumnRenamed("id", "node_id")
    assert sorted(map(tuple, communities.sweep_communities(edges, nodes).collect())) == [(i, i) for i in range(5)]
