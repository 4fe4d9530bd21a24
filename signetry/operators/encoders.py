"""Node encoders: spectral features, signed neighbour means, and two trained encoders.

Training runs in workers, one per seed and configuration; its result is a table of node states. Larger graphs are
trained in blocks of edges by the undirected encoder; with the directed one they take states as input.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import autograd as ag
from .events import message_edges
from .laplacian import DENSE, HELD, HELD_EDGES, NEAR_ROWS, _held_multiplier, _multiplier, array_multiplier

STATE = "node_id bigint, state array<double>"
FEATURE_EDGES = 20_000_000  # that the worker of spectral features multiplies with
FEATURE_NUMBERS = 40_000_000  # of its block of vectors
FEATURE_ROWS = 65_536  # written, or taken from degrees, at once
QR_ROWS = 65_536  # decomposed at once
MOST_EDGES = 5_000_000  # that one worker trains on at once
BLOCK_EDGES = 1_000_000  # beyond which they are trained on in blocks, where the encoder has that form
EDGE_BLOCK = 250_000  # edges of a block
MARGIN = 0.5  # by which the status of two ends is to differ


def signed_neighbour_mean(edges: DataFrame, state: DataFrame) -> DataFrame:
    """``node_id, sign, axis, mean``: the mean state of a node's positive and of its negative neighbours."""
    there = state.select(F.col("node_id").alias("target"), F.posexplode("state").alias("axis", "x"))
    sent = message_edges(edges.select("source", "target", "sign")).join(there, "target")
    return sent.groupBy(F.col("source").alias("node_id"), "sign", "axis").agg(F.avg("x").alias("mean"))


def spectral_features(edges: DataFrame, n: int, dimension: int, rounds: int = 128, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """``node_id, state``: right singular vectors of the signed adjacency by subspace iteration, and the singular values.

    Small adjacencies are decomposed densely. Otherwise every round multiplies a block of vectors with the adjacency twice and orthogonalises
    it; rounds end early once the subspace is still. Up to FEATURE_EDGES edges and FEATURE_NUMBERS numbers a worker that holds both does all rounds.
    Beyond that the driver holds the vectors.
    """
    spark = edges.sparkSession
    if n <= DENSE:
        rows = edges.select("source", "target", F.signum("sign").alias("v")).toPandas()
        dense = np.zeros((n, n))
        for a, b in (("source", "target"), ("target", "source")):
            np.add.at(dense, (rows[a].to_numpy(), rows[b].to_numpy()), rows["v"].to_numpy())
        values, vectors = np.linalg.eigh(dense)
        order = np.argsort(-np.abs(values), kind="stable")[:dimension]
        return spark.createDataFrame(pd.DataFrame({"node_id": np.arange(n), "state": vectors[:, order].tolist()}), STATE), np.abs(values[order])
    signed = edges.select("source", "target", F.signum("sign").cast("double").alias("c"))
    width = min(n, dimension + 8)
    if n * width <= FEATURE_NUMBERS and signed.limit(FEATURE_EDGES + 1).count() <= FEATURE_EDGES:
        return _worker_features(signed, n, width, dimension, rounds, seed)
    if n * dimension > HELD:
        raise ValueError("too many numbers for the driver")
    if signed.limit(HELD_EDGES + 1).count() <= HELD_EDGES:
        times, degree = _held_multiplier(signed, n)
    else:
        times, doubled = _multiplier(signed, n)
        degree = np.zeros(n)
        rows = doubled.groupBy("source").agg(F.sum("c").alias("d")).toPandas()
        degree[rows["source"].to_numpy()] = rows["d"].to_numpy()
    adjacency = lambda x: degree[:, None] * x - times(x)  # noqa: E731 - the multiplier gives D x - A x
    x, values = _subspace(adjacency, n, width, dimension, rounds, seed)
    return spark.createDataFrame(pd.DataFrame({"node_id": np.arange(n), "state": x.tolist()}), STATE), values


def _orthogonal(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The QR decomposition of a tall block, by that of the triangles of its blocks of rows, which needs less memory than LAPACK's."""
    parts = [np.linalg.qr(x[k : k + QR_ROWS]) for k in range(0, len(x), QR_ROWS)]
    if len(parts) == 1:
        return parts[0]
    own, r = np.linalg.qr(np.vstack([p[1] for p in parts]))
    at = 0
    for k, (q, small) in enumerate(parts):
        x[k * QR_ROWS : k * QR_ROWS + len(q)] = q @ own[at : at + len(small)]
        parts[k] = None
        at += len(small)
    return x, r


def _subspace(adjacency, n: int, width: int, dimension: int, rounds: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of the values greatest by size, and these without sign."""
    q, _ = _orthogonal(np.random.default_rng(seed).standard_normal((n, width)))
    last = np.zeros(dimension)
    for _ in range(rounds):
        q, r = _orthogonal(adjacency(adjacency(q)))
        values = np.sqrt(np.abs(np.diag(r)))[:dimension]
        if np.allclose(np.sort(values), np.sort(last), rtol=1e-6):
            break
        last = values
    small = q.T @ adjacency(q)
    values, vectors = np.linalg.eigh(small)
    order = np.argsort(-np.abs(values))[:dimension]
    return q @ vectors[:, order], np.abs(values[order])


def _worker_features(signed: DataFrame, n: int, width: int, dimension: int, rounds: int, seed: int) -> tuple[DataFrame, np.ndarray]:
    """``spectral_features`` by one worker, which gets the edges by shuffle; the driver holds neither edges nor vectors."""

    def made(batches):
        parts = [[b.column(k).to_numpy(zero_copy_only=False) for k in range(3)] for b in batches]
        source, target, c = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in range(3))
        del parts
        times, degree = array_multiplier(source.astype(np.int32), target.astype(np.int32), c.astype(float), n)
        del source, target, c

        def adjacency(x: np.ndarray) -> np.ndarray:
            out = times(x)
            for at in range(0, n, FEATURE_ROWS):
                own = slice(at, at + FEATURE_ROWS)
                np.subtract(degree[own, None] * x[own], out[own], out=out[own])  # the multiplier gives D x - A x
            return out

        x, values = _subspace(adjacency, n, width, dimension, rounds, seed)
        yield pa.record_batch([pa.array([-1], pa.int64()), pa.array([values.tolist()], lists)], names=["node_id", "state"])
        for at in range(0, n, FEATURE_ROWS):
            own = np.ascontiguousarray(x[at : at + FEATURE_ROWS])
            state = pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, own.shape[1]), pa.int32()), pa.array(own.ravel()))
            yield pa.record_batch([pa.array(np.arange(at, at + len(own))), state], names=["node_id", "state"])

    lists = pa.list_(pa.float64())
    few = signed.select(F.col("source").cast("int"), F.col("target").cast("int"), F.col("c").cast("byte")).repartition(1)
    rows = stored(few.mapInArrow(made, STATE))
    return rows.where("node_id >= 0"), np.array(rows.where("node_id < 0").first()["state"])


@dataclass(frozen=True)
class EncoderConfig:
    input_dimension: int = 64
    output_dimension: int = 64
    layers: int = 2
    learning_rate: float = 0.01
    epochs: int = 100
    balance: float = 5.0  # weight of the structure loss
    direction: float = 5.0  # weight of the direction loss
    triangle: float = 1.0  # weight of the triangle loss


class Encoder(ABC):
    """What the pipeline asks of an encoder."""

    directed = False

    @abstractmethod
    def fit(self, edges: np.ndarray, n: int, features: np.ndarray, config: EncoderConfig, seed: int) -> np.ndarray:
        """Node states from edges (source, target, sign) and input features."""

    def states(self, edges: DataFrame, features: DataFrame, config: EncoderConfig, seeds: list[int]) -> DataFrame:
        """``seed, node_id, state`` trained by one worker per seed, all edges at once; non-finite states raise an error."""
        spark = edges.sparkSession
        if not self.fits(edges, features, config):
            raise ValueError("the graph does not fit a worker; use trained_states, spectral_features or give the states")
        got = edges.select("source", "target", "sign").toArrow()
        rows = np.stack([got[k].to_numpy().astype(np.int64) for k in got.column_names], axis=1)
        table = features.toPandas().sort_values("node_id")
        x = np.array(table["state"].tolist(), float)
        n = len(x)

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            seed = int(frame["seed"].iloc[0])
            state = self.fit(rows, n, x, config, seed)
            if not np.isfinite(state).all():
                raise ValueError("the state is not finite")
            return pd.DataFrame({"seed": seed, "node_id": np.arange(n), "state": list(state)})

        return spark.createDataFrame([(s,) for s in seeds], "seed int").groupBy("seed").applyInPandas(run, f"seed int, {STATE}")

    @staticmethod
    def fits(edges: DataFrame, features: DataFrame, config: EncoderConfig) -> bool:
        """Whether one worker trains on all edges at once."""
        return edges.limit(MOST_EDGES + 1).count() <= MOST_EDGES and features.count() * max(config.input_dimension, 1) <= HELD

    def trained_states(self, edges: DataFrame, features: DataFrame, config: EncoderConfig, seeds: list[int]) -> DataFrame:
        """``states`` of a graph of any size, where the encoder has a form for large ones."""
        return self.states(edges, features, config, seeds)


def _weights(rng: np.random.Generator, *shape: int) -> ag.Node:
    return ag.Node(rng.standard_normal(shape) / np.sqrt(shape[0]))


def _mean_of(x: ag.Node, source: np.ndarray, target: np.ndarray, n: int) -> ag.Node:
    """Mean of the neighbours' rows; zeros for nodes without any."""
    return ag.add_up(ag.take(x, target), source, n) * (1.0 / np.maximum(np.bincount(source, minlength=n), 1))[:, None]


class _Trained(Encoder):
    """Full-batch training with adapted step widths; subclasses give the parameters, the states and the loss."""

    def prepare(self, edges: np.ndarray, n: int, width: int, config: EncoderConfig, rng: np.random.Generator) -> None:
        raise NotImplementedError

    def forward(self, features: ag.Node) -> ag.Node:
        raise NotImplementedError

    def loss(self, z: ag.Node, rng: np.random.Generator) -> ag.Node:
        raise NotImplementedError

    def fit(self, edges: np.ndarray, n: int, features: np.ndarray, config: EncoderConfig, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        self.prepare(edges, n, features.shape[1], config, rng)
        first, second = [np.zeros_like(p.data) for p in self.parameters], [np.zeros_like(p.data) for p in self.parameters]
        x = ag.Node(features)
        for epoch in range(1, config.epochs + 1):
            loss = self.loss(self.forward(x), rng)
            if not np.isfinite(loss.data):
                raise ValueError("the loss is not finite")
            loss.gradients()
            self.descend(first, second, epoch, config.learning_rate)
        return self.forward(x).data

    def descend(self, first: list[np.ndarray], second: list[np.ndarray], epoch: int, rate: float) -> None:
        """Moves the parameters down their gradients; ``first`` and ``second`` are the running moments."""
        for q, m, s in zip(self.parameters, first, second):
            m += 0.1 * (q.grad - m)
            s += 0.001 * (q.grad * q.grad - s)
            q.data -= rate * (m / (1 - 0.9**epoch)) / (np.sqrt(s / (1 - 0.999**epoch)) + 1e-8)


def structure_loss(z: ag.Node, source: np.ndarray, target: np.ndarray, sign: np.ndarray, stranger: np.ndarray) -> ag.Node:
    """Friends are to be nearer than strangers, and strangers nearer than enemies."""
    square = lambda a, b: ag.row_sums((ag.take(z, a) - ag.take(z, b)) * (ag.take(z, a) - ag.take(z, b)))
    return ag.mean(ag.relu((square(source, target) - square(source, stranger)) * np.sign(sign)[:, None].astype(float)))


class UndirectedSigned(_Trained):
    """Signed graph convolution of undirected graphs, as published by Derr, Ma and Tang (2018).

    Every node has a balanced and an unbalanced half. The first layer takes friends into the balanced and enemies
    into the unbalanced half; further layers follow the balance of paths: a friend's balanced and an enemy's
    unbalanced half go into the balanced one, and the other way round. Training tells the signs of edges and
    non-edges apart and adds the structure loss. Without negative edges the loss is that of links only: edges
    against as many random pairs, and friends nearer than strangers.
    """

    def prepare(self, edges, n, width, config, rng):
        self.n, self.config, self.edges = n, config, edges
        way = np.sign(edges[:, 2])
        ends = lambda own: (np.concatenate([own[:, 0], own[:, 1]]), np.concatenate([own[:, 1], own[:, 0]]))
        self.friends, self.enemies = ends(edges[way > 0]), ends(edges[way < 0])
        self.draw(width, config, rng, not (way < 0).any())

    def draw(self, width: int, config: EncoderConfig, rng: np.random.Generator, only_positive: bool) -> None:
        """The first weights."""
        if config.output_dimension % 2:
            raise ValueError("the output must have two equal halves")
        half, self.only_positive = config.output_dimension // 2, bool(only_positive)
        sizes = [2 * width] + [3 * half] * (config.layers - 1)
        self.balanced = [_weights(rng, size, half) for size in sizes]
        self.unbalanced = [_weights(rng, size, half) for size in sizes]
        self.readout = _weights(rng, 2 * config.output_dimension, 2 if self.only_positive else 3)
        self.parameters = [*self.balanced, *self.unbalanced, self.readout]

    def forward(self, features):
        near = lambda x, of: _mean_of(x, *of, self.n)
        b = ag.tanh(ag.beside(near(features, self.friends), features) @ self.balanced[0])
        u = ag.tanh(ag.beside(near(features, self.enemies), features) @ self.unbalanced[0])
        for wb, wu in zip(self.balanced[1:], self.unbalanced[1:]):
            b, u = (
                ag.tanh(ag.beside(near(b, self.friends), near(u, self.enemies), b) @ wb),
                ag.tanh(ag.beside(near(u, self.friends), near(b, self.enemies), u) @ wu),
            )
        return ag.beside(b, u)

    def loss(self, z, rng):
        source, target, sign = self.edges.T
        none = 1 if self.only_positive else 2
        u = np.concatenate([source, rng.integers(0, self.n, len(source))])
        v = np.concatenate([target, rng.integers(0, self.n, len(source))])
        label = np.concatenate([np.where(sign > 0, 0, 1), np.full(len(source), none)])
        link = ag.cross_entropy(ag.beside(ag.take(z, u), ag.take(z, v)) @ self.readout, label)
        return link + structure_loss(z, source, target, sign, rng.integers(0, self.n, len(source))) * self.config.balance

    # the same training in blocks of edges, with its derivatives written out
    def trained_states(self, edges, features, config, seeds):
        if edges.limit(BLOCK_EDGES + 1).count() <= BLOCK_EDGES and self.fits(edges, features, config):
            return self.states(edges, features, config, seeds)
        each = F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed")
        rows = edges.select(F.col("source").cast("int"), F.col("target").cast("int"), F.signum("sign").cast("tinyint").alias("sign"), each)
        nodes = features.select("node_id", "state", each)

        def run(key: tuple, rows: pa.Table, nodes: pa.Table) -> pa.Table:
            seed, order = key[0].as_py(), np.argsort(nodes["node_id"].to_numpy())
            values, n = nodes["state"].combine_chunks().flatten().to_numpy(zero_copy_only=False), len(order)
            x = values.reshape(n, -1).astype(float)[order]
            source, target, sign = (rows[k].to_numpy() for k in ("source", "target", "sign"))
            order = np.argsort(source.astype(np.int64) * n + target)  # draws don't hang on the order of the shuffle
            z = type(self)().fit_blocks(source[order], target[order], sign[order], n, x, config, seed)
            if not np.isfinite(z).all():
                raise ValueError("the state is not finite")
            parts = []
            for a in range(0, n, NEAR_ROWS):
                own = z[a : a + NEAR_ROWS]
                ends = pa.array(np.arange(0, own.size + 1, z.shape[1], dtype=np.int32))
                state = pa.ListArray.from_arrays(ends, pa.array(own.ravel()))
                parts.append(pa.table({"seed": pa.array(np.full(len(own), seed, np.int32)), "node_id": pa.array(np.arange(a, a + len(own))), "state": state}))
            return pa.concat_tables(parts)

        return rows.groupBy("seed").cogroup(nodes.groupBy("seed")).applyInArrow(run, f"seed int, {STATE}")

    def fit_blocks(self, source: np.ndarray, target: np.ndarray, sign: np.ndarray, n: int, x: np.ndarray, config: EncoderConfig, seed: int, block: int = EDGE_BLOCK) -> np.ndarray:
        """What ``fit`` gives up to rounding, without arrays of a row of numbers for every edge."""
        rng = np.random.default_rng(seed)
        self.n, self.config = n, config
        self.draw(x.shape[1], config, rng, not (sign < 0).any())
        near = [_Near(source[own], target[own], n) for own in (sign > 0, sign < 0)]
        first, second = [np.zeros_like(p.data) for p in self.parameters], [np.zeros_like(p.data) for p in self.parameters]
        for epoch in range(1, config.epochs + 1):
            layers = self._layers(x, near)
            loss, slope = self._block_loss(np.hstack(layers[-1]), source, target, sign, [rng.integers(0, n, len(source)).astype(np.int32) for _ in range(3)], block)
            if not np.isfinite(loss):
                raise ValueError("the loss is not finite")
            self._slopes(x, near, layers, slope)
            self.descend(first, second, epoch, config.learning_rate)
        return np.hstack(self._layers(x, near)[-1])

    def _layers(self, x: np.ndarray, near: list[_Near]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Both halves after each layer; means are taken after the weights, which leaves fewer columns."""
        friends, enemies = near
        d, (wb, wu) = x.shape[1], (self.balanced[0].data, self.unbalanced[0].data)
        out = [(np.tanh(friends.mean(x @ wb[:d]) + x @ wb[d:]), np.tanh(enemies.mean(x @ wu[:d]) + x @ wu[d:]))]
        for one, two in zip(self.balanced[1:], self.unbalanced[1:]):
            (b, u), wb, wu, h = out[-1], one.data, two.data, one.data.shape[1]
            total = friends.mean(np.hstack([b @ wb[:h], u @ wu[:h]]))
            total += enemies.mean(np.hstack([u @ wb[h : 2 * h], b @ wu[h : 2 * h]]))
            out.append((np.tanh(total[:, :h] + b @ wb[2 * h :]), np.tanh(total[:, h:] + u @ wu[2 * h :])))
        return out

    def _block_loss(self, z: np.ndarray, source: np.ndarray, target: np.ndarray, sign: np.ndarray, strangers: list[np.ndarray], block: int) -> tuple[float, np.ndarray]:
        """The loss and its slope at the states; that at the readout goes to its ``grad``."""
        d, readout, m, balance = z.shape[1], self.readout.data, len(source), self.config.balance
        slope, own, loss = np.zeros_like(z), np.zeros_like(readout), 0.0
        flat = slope.reshape(-1)

        def add(rows: np.ndarray, g: np.ndarray) -> None:
            np.add.at(flat, (rows.astype(np.int64)[:, None] * d + np.arange(d)).ravel(), g.ravel())

        for a in range(0, m, block):
            s, t, way, *drawn = (k[a : a + block] for k in (source, target, sign, *strangers))
            at = np.arange(len(s))
            for p, q, label in ((s, t, np.where(way > 0, 0, 1)), (drawn[0], drawn[1], 1 if self.only_positive else 2)):
                zp, zq = z[p], z[q]
                share = zp @ readout[:d] + zq @ readout[d:]
                share = np.exp(share - share.max(1, keepdims=True))
                share /= share.sum(1, keepdims=True)
                loss -= np.log(np.maximum(share[at, label], 1e-300)).sum() / (2 * m)
                share[at, label] -= 1
                share /= 2 * m
                own[:d] += zp.T @ share
                own[d:] += zq.T @ share
                add(p, share @ readout[:d].T)
                add(q, share @ readout[d:].T)
            friend, other = z[s] - z[t], z[s] - z[drawn[2]]
            gap = ((friend * friend).sum(1) - (other * other).sum(1)) * way
            loss += balance * np.maximum(gap, 0).sum() / m
            weight = (np.where(gap > 0, way, 0) * (2.0 * balance / m))[:, None]
            add(s, weight * (friend - other))
            add(t, -weight * friend)
            add(drawn[2], weight * other)
        self.readout.grad = own
        return loss, slope

    def _slopes(self, x: np.ndarray, near: list[_Near], layers: list[tuple[np.ndarray, np.ndarray]], slope: np.ndarray) -> None:
        """The gradients of the layers' weights from the slope at the states, which is overwritten."""
        friends, enemies = near
        both, h = slope, slope.shape[1] // 2
        for k in range(len(layers) - 1, -1, -1):
            one, two, (b, u) = self.balanced[k], self.unbalanced[k], layers[k]
            both[:, :h] *= 1 - b * b
            both[:, h:] *= 1 - u * u
            db, du = both[:, :h], both[:, h:]
            if not k:
                one.grad = np.vstack([x.T @ friends.back(db), x.T @ db])
                two.grad = np.vstack([x.T @ enemies.back(du), x.T @ du])
                return
            b, u = layers[k - 1]
            f, e = friends.back(both), enemies.back(both)
            one.grad = np.vstack([b.T @ f[:, :h], u.T @ e[:, :h], b.T @ db])
            two.grad = np.vstack([u.T @ f[:, h:], b.T @ e[:, h:], u.T @ du])
            wb, wu = one.data, two.data
            both = np.hstack([f[:, :h] @ wb[:h].T + e[:, h:] @ wu[h : 2 * h].T + db @ wb[2 * h :].T, e[:, :h] @ wb[h : 2 * h].T + f[:, h:] @ wu[:h].T + du @ wu[2 * h :].T])


class _Near:
    """Means over the neighbours by undirected edges, some whole nodes at a time, and their transpose."""

    def __init__(self, one: np.ndarray, two: np.ndarray, n: int) -> None:
        u, v = np.concatenate([one, two]), np.concatenate([two, one])
        self.v = v[np.argsort(u, kind="stable")]
        counts = np.bincount(u, minlength=n)
        self.nodes = np.flatnonzero(counts)
        self.ends = np.append(0, np.cumsum(counts[self.nodes]))
        self.share = (1.0 / np.maximum(counts, 1))[:, None]

    def _sums(self, x: np.ndarray) -> np.ndarray:
        out, at = np.zeros_like(x), 0
        while at < len(self.nodes):
            a = self.ends[at]
            to = max(at + 1, int(np.searchsorted(self.ends, a + NEAR_ROWS, side="right")) - 1)
            out[self.nodes[at:to]] = np.add.reduceat(x[self.v[a : self.ends[to]]], self.ends[at:to] - a, axis=0)
            at = to
        return out

    def mean(self, x: np.ndarray) -> np.ndarray:
        return self._sums(x) * self.share

    def back(self, g: np.ndarray) -> np.ndarray:
        return self._sums(g * self.share)


class DirectedSigned(_Trained):
    """Signed directed network encoder after Huang, Shen, Cao, Tao and Cheng (2021).

    Friends and enemies, incoming and outgoing, are four relations. In each a node takes its neighbours by
    attention; what it has itself and what the relations bring goes through two layers. The loss has the signs of
    edges, their direction by status (a positive edge points to a node of higher, a negative one to a node of
    lower status), and the signs of edges once more, weighted by the triangles they are in.
    """

    directed = True

    def prepare(self, edges, n, width, config, rng):
        if width != config.output_dimension:
            raise ValueError("input and output must have the same width")
        self.n, self.config, self.edges = n, config, edges
        self.relations = []
        for way in (1, -1):
            own = edges[np.sign(edges[:, 2]) == way]
            self.relations += [(own[:, 0], own[:, 1]), (own[:, 1], own[:, 0])]
        self.maps = [[_weights(rng, width, width) for _ in self.relations] for _ in range(config.layers)]
        self.looks = [[(_weights(rng, width, 1), _weights(rng, width, 1)) for _ in self.relations] for _ in range(config.layers)]
        self.mixes = [(_weights(rng, 5 * width, width), _weights(rng, width, width)) for _ in range(config.layers)]
        self.status = _weights(rng, width, 1)
        looks = [w for layer in self.looks for pair in layer for w in pair]
        self.parameters = [*(w for layer in self.maps for w in layer), *looks, *(w for pair in self.mixes for w in pair), self.status]
        self.triangles = _triangles(edges, n)

    def forward(self, features):
        x = features
        for maps, looks, (inner, outer) in zip(self.maps, self.looks, self.mixes):
            parts = [x]
            for (source, target), w, (own, other) in zip(self.relations, maps, looks):
                y = x @ w
                raw = ag.relu(ag.take(y @ own, source) + ag.take(y @ other, target), 0.2)
                high = np.full((self.n, 1), -np.inf)
                np.maximum.at(high, source, raw.data)
                weight = ag.exp(raw - high[source])
                total = ag.add_up(weight, source, self.n)
                share = weight * ag.take(ag.inverse(total + (total.data == 0).astype(float)), source)
                parts.append(ag.add_up(ag.take(y, target) * share, source, self.n))
            x = ag.tanh(ag.beside(*parts) @ inner) @ outer
        return x

    def loss(self, z, rng):
        source, target, sign = self.edges.T
        way = np.sign(sign)[:, None].astype(float)
        agree = ag.softplus(ag.row_sums(ag.take(z, source) * ag.take(z, target)) * -way)
        rank = z @ self.status
        gap = ag.relu((ag.take(rank, target) - ag.take(rank, source)) * -way + MARGIN)
        weight = self.triangles[:, None] / max(self.triangles.sum(), 1.0) * len(self.triangles)
        return ag.mean(agree) + ag.mean(gap * gap) * self.config.direction + ag.mean(agree * weight) * self.config.triangle


def _triangles(edges: np.ndarray, n: int) -> np.ndarray:
    """Number of triangles that each edge closes, directions aside."""
    a, b = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    pairs = np.unique(a * n + b)
    order = np.split(pairs % n, np.searchsorted(pairs // n, np.arange(1, n)))
    near = [set(x.tolist()) for x in order]
    return np.array([len(near[u] & near[v]) for u, v in edges[:, :2].tolist()], float)


ENCODERS: dict[str, type[Encoder]] = {"undirected": UndirectedSigned, "directed": DirectedSigned}
