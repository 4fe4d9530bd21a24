"""Reverse-mode derivatives of the few array operations that the encoders are made of."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Node:
    """An array with the way its gradient goes back to the arrays it was made from."""

    def __init__(self, data: np.ndarray, parents: tuple[Node, ...] = (), back: Callable | None = None) -> None:
        self.data, self.parents, self.back = np.asarray(data, float), parents, back
        self.grad: np.ndarray | None = None

    def __add__(self, other) -> Node:
        other = node(other)
        return Node(self.data + other.data, (self, other), lambda g: (_fitted(g, self), _fitted(g, other)))

    def __mul__(self, other) -> Node:
        other = node(other)
        return Node(self.data * other.data, (self, other), lambda g: (_fitted(g * other.data, self), _fitted(g * self.data, other)))

    def __sub__(self, other) -> Node:
        return self + node(other) * -1.0

    def __matmul__(self, other: Node) -> Node:
        return Node(self.data @ other.data, (self, other), lambda g: (g @ other.data.T, self.data.T @ g))

    __radd__, __rmul__ = __add__, __mul__

    def gradients(self) -> None:
        """Fill ``grad`` of everything this number was made from."""
        order, seen, stack = [], set(), [(self, False)]
        while stack:
            at, done = stack.pop()
            if done:
                order.append(at)
            elif id(at) not in seen:
                seen.add(id(at))
                stack.append((at, True))
                stack += [(p, False) for p in at.parents]
        for at in order:
            at.grad = np.zeros_like(at.data)
        self.grad = np.ones_like(self.data)
        for at in reversed(order):
            if at.back:
                for parent, g in zip(at.parents, at.back(at.grad)):
                    parent.grad += g


def node(x) -> Node:
    return x if isinstance(x, Node) else Node(x)


def _fitted(g: np.ndarray, to: Node) -> np.ndarray:
    """The gradient summed over the places that were broadcast."""
    g = g.sum(tuple(range(g.ndim - to.data.ndim)))
    return g.sum(tuple(i for i, n in enumerate(to.data.shape) if n == 1 and g.shape[i] > 1), keepdims=True)


def _pointwise(x: Node, value: np.ndarray, slope: np.ndarray) -> Node:
    return Node(value, (x,), lambda g: (g * slope,))


def tanh(x: Node) -> Node:
    y = np.tanh(x.data)
    return _pointwise(x, y, 1 - y * y)


def relu(x: Node, leak: float = 0.0) -> Node:
    return _pointwise(x, np.where(x.data > 0, x.data, leak * x.data), np.where(x.data > 0, 1.0, leak))


def exp(x: Node) -> Node:
    y = np.exp(x.data)
    return _pointwise(x, y, y)


def inverse(x: Node) -> Node:
    return _pointwise(x, 1 / x.data, -1 / x.data**2)


def softplus(x: Node) -> Node:
    return _pointwise(x, np.logaddexp(0, x.data), 1 / (1 + np.exp(-np.clip(x.data, -500, 500))))


def take(x: Node, rows: np.ndarray) -> Node:
    def back(g):
        out = np.zeros_like(x.data)
        np.add.at(out, rows, g)
        return (out,)

    return Node(x.data[rows], (x,), back)


def add_up(x: Node, rows: np.ndarray, n: int) -> Node:
    """Sums of the rows of ``x`` by the group each belongs to."""
    out = np.zeros((n, *x.data.shape[1:]))
    np.add.at(out, rows, x.data)
    return Node(out, (x,), lambda g: (g[rows],))


def beside(*parts: Node) -> Node:
    ends = np.cumsum([p.data.shape[1] for p in parts])
    return Node(np.concatenate([p.data for p in parts], 1), parts, lambda g: tuple(np.split(g, ends[:-1], 1)))


def row_sums(x: Node) -> Node:
    return Node(x.data.sum(1, keepdims=True), (x,), lambda g: (np.broadcast_to(g, x.data.shape),))


def mean(x: Node) -> Node:
    n = max(x.data.size, 1)
    return Node(x.data.sum() / n, (x,), lambda g: (np.full(x.data.shape, g / n),))


def cross_entropy(scores: Node, labels: np.ndarray) -> Node:
    """Mean of the negative log shares of the labels."""
    p = np.exp(scores.data - scores.data.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    at = np.arange(len(labels))
    hot = np.zeros_like(p)
    hot[at, labels] = 1
    return Node(-np.log(np.maximum(p[at, labels], 1e-300)).mean(), (scores,), lambda g: (g * (p - hot) / len(labels),))
