import numpy as np
import pytest

from signetry.operators import autograd as ag
from signetry.operators import encoders as en


def _slopes(make, arrays, eps=1e-6):
    """Gradients of ``make(nodes)`` beside finite differences."""
    nodes = [ag.Node(a.copy()) for a in arrays]
    make(nodes).gradients()
    for k, a in enumerate(arrays):
        for at in np.ndindex(*a.shape):
            up, down = ([x.copy() for x in arrays] for _ in range(2))
            up[k][at] += eps
            down[k][at] -= eps
            plain = (make([ag.Node(x) for x in up]).data - make([ag.Node(x) for x in down]).data) / (2 * eps)
            assert nodes[k].grad[at] == pytest.approx(plain, abs=1e-5)


def test_derivatives_equal_finite_differences():
    r = np.random.default_rng(0)
    rows = np.array([0, 2, 1, 0])
    _slopes(lambda v: ag.mean(ag.tanh(v[0] @ v[1]) * ag.exp(v[2])), [r.standard_normal((3, 2)), r.standard_normal((2, 4)), r.standard_normal((1, 4))])
    _slopes(lambda v: ag.mean(ag.softplus(ag.row_sums(ag.take(v[0], rows) * ag.take(v[1], rows[::-1])))), [r.standard_normal((3, 2)), r.standard_normal((3, 2))])
    _slopes(lambda v: ag.mean(ag.relu(ag.add_up(v[0], rows, 3), 0.2) * ag.inverse(ag.exp(v[1]) + 1.0)), [r.standard_normal((4, 2)), r.standard_normal((3, 1))])
    _slopes(lambda v: ag.cross_entropy(ag.beside(v[0], v[1] - v[0]), np.array([0, 3, 2])), [r.standard_normal((3, 2)), r.standard_normal((3, 2))])


def _two_camps(seed=0, n=20, enemies=True):
    r = np.random.default_rng(seed)
    out = []
    for u in range(n):
        for v in range(u + 1, n):
            if r.random() < 0.5:
                same = (u < n // 2) == (v < n // 2)
                if same or enemies:
                    out.append((u, v, 1 if same else -1))
    return np.array(out), r.standard_normal((n, 4))


@pytest.mark.parametrize("kind", ["undirected", "directed"])
def test_parameters_of_the_encoders_have_the_right_slopes(kind):
    edges, x = _two_camps(n=8)
    encoder, rng = en.ENCODERS[kind](), np.random.default_rng(1)
    encoder.prepare(edges, 8, 4, en.EncoderConfig(4, 4, 2), rng)
    value = lambda: encoder.loss(encoder.forward(ag.Node(x)), np.random.default_rng(7))
    value().gradients()
    for p in encoder.parameters:
        at = tuple(np.random.default_rng(3).integers(0, p.data.shape))
        grad, kept = p.grad[at], p.data[at]
        p.data[at] = kept + 1e-6
        up = value().data
        p.data[at] = kept - 1e-6
        down = value().data
        p.data[at] = kept
        assert grad == pytest.approx((up - down) / 2e-6, abs=1e-4)


def test_balanced_paths_tell_camps_apart():
    edges, x = _two_camps()
    z = en.UndirectedSigned().fit(edges, 20, x, en.EncoderConfig(4, 8, 2, 0.02, 80), 0)
    d = ((z[:, None] - z[None]) ** 2).sum(2)
    inside = d[:10, :10].sum() / 90
    assert inside < 0.5 * d[:10, 10:].mean()


def test_an_enemy_of_an_enemy_goes_into_the_balanced_half():
    """On the path 0 - 1 - 2 of two negative edges the second layer brings node 0 what node 1's unbalanced half has of 2."""
    encoder = en.UndirectedSigned()
    encoder.prepare(np.array([(0, 1, -1), (1, 2, -1)]), 3, 2, en.EncoderConfig(2, 4, 2), np.random.default_rng(0))
    x = np.eye(3, 2)
    before = encoder.forward(ag.Node(x)).data
    y = x.copy()
    y[2] = 5.0
    after = encoder.forward(ag.Node(y)).data
    assert np.abs(after[0, :2] - before[0, :2]).max() > 1e-6  # balanced: enemy of an enemy
    assert np.abs(after[0, 2:] - before[0, 2:]).max() < 1e-12  # unbalanced: nothing of it in two steps


def test_the_loss_of_positive_graphs_has_links_only():
    edges, x = _two_camps(enemies=False)
    encoder = en.UndirectedSigned()
    encoder.prepare(edges, 20, 4, en.EncoderConfig(4, 8), np.random.default_rng(0))
    assert encoder.only_positive and encoder.readout.data.shape == (16, 2)
    z = encoder.fit(edges, 20, x, en.EncoderConfig(4, 8, 2, 0.02, 60), 0)
    d = ((z[:, None] - z[None]) ** 2).sum(2)
    assert d[:10, :10].mean() < d[:10, 10:].mean()


def test_direction_follows_status_and_triangles_are_counted():
    assert en._triangles(np.array([(0, 1, 1), (1, 2, 1), (2, 0, -1), (2, 3, 1)]), 4).tolist() == [1, 1, 1, 0]
    chain = np.array([(i, j, 1) for i in range(6) for j in range(i + 1, 6)])
    encoder = en.DirectedSigned()
    z = encoder.fit(chain, 6, np.random.default_rng(2).standard_normal((6, 4)), en.EncoderConfig(4, 4, 1, 0.02, 200), 0)
    rank = (z @ encoder.status.data)[:, 0]
    assert np.corrcoef(rank, np.arange(6))[0, 1] > 0.8


def test_graphs_beyond_a_worker_are_refused_before_they_are_collected(spark, monkeypatch):
    monkeypatch.setattr(en, "MOST_EDGES", 2)
    edges = spark.createDataFrame([(0, 1, 1), (1, 2, 1), (2, 3, -1)], "source bigint, target bigint, sign int")
    features = spark.createDataFrame([(i, [0.0, 1.0]) for i in range(4)], en.STATE)
    with pytest.raises(ValueError, match="does not fit"):
        en.UndirectedSigned().states(edges, features, en.EncoderConfig(2, 2), [0])
