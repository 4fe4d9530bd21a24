from signetry.operators import communities


def test_communities_that_no_friend_would_be_left_for_are_not_looked_at(monkeypatch):
    """Enemies of a hub that have a friend each: what the hub's other enemies offer is less than the friend."""
    n, seen = 1_201, []
    edges = [(0, i, -1) for i in range(1, n)] + [(i, i + 1, 1) for i in range(1, n - 1, 2)]
    plain = communities._worthy

    def watched(every, *rest):
        seen.append(len(every))
        return plain(every, *rest)

    monkeypatch.setattr(communities, "_worthy", watched)
    found = communities.local_louvain(edges, list(range(n)), 0)
    assert sum(seen) < n * n
    monkeypatch.setattr(communities, "HUB", 10**9)
    assert communities.local_louvain(edges, list(range(n)), 0) == found
