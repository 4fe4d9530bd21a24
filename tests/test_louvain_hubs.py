import random
import time

import pytest

from signetry.operators import communities


def _graph(seed: int, n: int = 80) -> list[tuple[int, int, int]]:
    r = random.Random(seed)
    pairs = {tuple(sorted((r.randrange(n), int(n * r.random() ** 3)))) for _ in range(3 * n)}
    return [(a, b, r.choice([1, -1, -1])) for a, b in sorted(pairs) if a != b]


@pytest.mark.parametrize("seed", range(4))
def test_counted_communities_of_hubs_give_the_same_moves(monkeypatch, seed):
    edges = _graph(seed)
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    monkeypatch.setattr(communities, "HUB", 10**9)
    plain = communities.local_louvain(edges, nodes, seed)
    for hub in (0, 2, 8):
        monkeypatch.setattr(communities, "HUB", hub)
        assert communities.local_louvain(edges, nodes, seed) == plain


def test_a_hub_of_enemies_costs_no_square_of_them():
    n = 6_000
    edges = [(0, i, -1) for i in range(1, n)] + [(i, i + 1, 1) for i in range(1, n - 1, 2)]
    began = time.process_time()
    communities.local_louvain(edges, list(range(n)), 0)
    assert time.process_time() - began < 20
