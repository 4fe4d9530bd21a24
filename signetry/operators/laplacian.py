"""Laplacians of signed graphs as rows, and systems solved with them.

Three solvers share one interface. Up to ``DENSE`` nodes the matrix is aggregated in Spark and solved densely.
Up to ``HELD`` numbers the vectors stay on the driver and every step sends them to the edge partitions, which
return block sums. Beyond that the vectors are a table and a step is a join and an aggregation.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import conductance
from ..session import discard, stored
from .components import is_connected
from .events import message_edges

DENSE = 4_096  # nodes
HELD = 16_000_000  # numbers per vector block on the driver: 128 MB
HELD_EDGES = 2_000_000  # edges that the driver multiplies with
AT_ONCE = 2_000_000  # numbers that a multiplication holds besides
NEAR_ROWS = 8_192  # edge ends multiplied at once, few enough for a core's cache
BLOCK = 65_536


class NotConverged(RuntimeError):
    """The iterations ended above the tolerance."""


def weighted_edges(edges: DataFrame, positive: float = 1.0, negative: float = 0.1) -> DataFrame:
    """``source, target, c``: the physical edges with their conductance."""
    return edges.select("source", "target", conductance("sign", positive, negative).alias("c"))


def laplacian_rows(conducting: DataFrame) -> DataFrame:
    """``row, col, value`` of the Laplacian of ``source, target, c``: degrees on the diagonal, -c elsewhere.

    An empty table gives no rows.
    """
    doubled = message_edges(conducting)
    off = doubled.groupBy(F.col("source").alias("row"), F.col("target").alias("col")).agg((-F.sum("c")).alias("value"))
    diagonal = doubled.groupBy(F.col("source").alias("row")).agg(F.sum("c").alias("value"))
    return off.unionByName(diagonal.select("row", F.col("row").alias("col"), "value"))


def negative_layer(edges: DataFrame) -> DataFrame:
    """``source, target, c`` of the negative edges with unit conductance."""
    return edges.where("sign < 0").select("source", "target", F.lit(1.0).alias("c"))


def check_nodes(edges: DataFrame, num_nodes: int) -> None:
    """Raise unless all endpoints are in 0..num_nodes-1 and the graph is one component."""
    low, high = edges.agg(F.min(F.least("source", "target")), F.max(F.greatest("source", "target"))).first()
    if low is None or low < 0 or high >= num_nodes:
        raise ValueError("an edge leaves the range of node ids")
    if not is_connected(edges, num_nodes):
        raise ValueError("the graph is not connected")


def spread_values(conducting: DataFrame, values: DataFrame) -> DataFrame:
    """``node_id, value`` of the Laplacian times ``values`` (node_id, value ARRAY<DOUBLE>), nodes without edges left out.

    One join along the edges and one aggregation, whose states are sums per axis.
    """
    width = values.select(F.max(F.size("value"))).first()[0] or 0
    there = values.select(F.col("node_id").alias("target"), F.col("value").alias("y"))
    sent = message_edges(conducting).join(there, "target")
    sums = sent.groupBy(F.col("source").alias("node_id")).agg(F.sum("c").alias("d"), *[F.sum(F.col("c") * F.col("y")[i]).alias(f"s{i}") for i in range(width)])
    joined = sums.join(values, "node_id")
    return joined.select("node_id", F.array(*[F.col("d") * F.col("value")[i] - F.col(f"s{i}") for i in range(width)]).alias("value"))


def quadratic_form(conducting: DataFrame, values: DataFrame) -> DataFrame:
    """One row ``energy``: the sum over edges of c times the squared difference, averaged over the axes."""
    s = values.select(F.col("node_id").alias("source"), F.col("value").alias("a"))
    t = values.select(F.col("node_id").alias("target"), F.col("value").alias("b"))
    square = F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)
    return conducting.join(s, "source").join(t, "target").agg(F.sum(F.col("c") * square / F.size("a")).alias("energy"))


# ---------------------------------------------------------------------------------- solvers
def _dense(conducting: DataFrame, n: int) -> np.ndarray:
    rows = conducting.groupBy("source", "target").agg(F.sum("c").alias("c")).toPandas()
    out = np.zeros((n, n))
    u, v, c = rows["source"].to_numpy(), rows["target"].to_numpy(), rows["c"].to_numpy()
    for a, b in ((u, v), (v, u)):
        np.add.at(out, (a, b), -c)
        np.add.at(out, (a, a), c)
    return out


def _multiplier(conducting: DataFrame, n: int):
    """Multiplication of the Laplacian with driver-held vectors, block sums being added before they come back."""
    doubled = stored(message_edges(conducting))
    spark = doubled.sparkSession

    def times(x: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(x)
        width = x.shape[1]

        def partial(frames):
            sums: dict[int, np.ndarray] = {}
            for frame in frames:
                u, v, c = (frame[k].to_numpy() for k in ("source", "target", "c"))
                part = c[:, None] * (shared.value[u] - shared.value[v])
                for block in np.unique(u // BLOCK):
                    at = np.flatnonzero(u // BLOCK == block)
                    own = sums.setdefault(int(block), np.zeros((min(BLOCK, n - int(block) * BLOCK), width)))
                    np.add.at(own, u[at] - int(block) * BLOCK, part[at])
            yield pd.DataFrame({"block": list(sums), "data": [s.tobytes() for s in sums.values()]}, columns=["block", "data"])

        def added(frame: pd.DataFrame) -> pd.DataFrame:
            total = reduce(np.add, (np.frombuffer(d) for d in frame["data"]))
            return pd.DataFrame({"block": [frame["block"].iloc[0]], "data": [total.tobytes()]})

        sent = doubled.mapInPandas(partial, "block bigint, data binary")
        rows = sent.groupBy("block").applyInPandas(added, "block bigint, data binary").collect()
        out = np.zeros_like(x)
        for r in rows:
            part = np.frombuffer(r["data"]).reshape(-1, width)
            out[r["block"] * BLOCK : r["block"] * BLOCK + len(part)] = part
        shared.unpersist()
        return out

    return times, doubled


def _held_multiplier(conducting: DataFrame, n: int):
    """Multiplication of the Laplacian held on the driver, and its diagonal; edges come by Arrow, not as Python rows."""
    rows = conducting.select(F.col("source").cast("int"), F.col("target").cast("int"), "c").toArrow()
    return array_multiplier(*(rows[k].to_numpy() for k in ("source", "target", "c")), n)


def array_multiplier(one: np.ndarray, two: np.ndarray, c: np.ndarray, n: int):
    """Multiplication of the Laplacian of edges in arrays, and its diagonal; some whole nodes at a time fill one buffer."""
    u, v, c = np.concatenate([one, two]), np.concatenate([two, one]), np.concatenate([c, c])
    order = np.argsort(u, kind="stable")
    u = u[order]  # one after the other, each old array being freed
    v = v[order]
    c = c[order]
    del order
    starts = np.flatnonzero(np.append(True, u[1:] != u[:-1])) if len(u) else np.zeros(0, np.int64)
    diagonal = np.bincount(u, c, n) if len(u) else np.zeros(n)
    ends, nodes = np.append(starts, len(u)), u[starts]
    runs, at = [], 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + NEAR_ROWS, side="right")) - 1)
        runs.append((at, to, int(ends[at]), int(ends[to])))
        at = to
    longest = max((b - a for _, _, a, b in runs), default=1)
    some = max(1, AT_ONCE // longest)

    def times(x: np.ndarray) -> np.ndarray:
        out = diagonal[:, None] * x
        for first in range(0, x.shape[1], some):
            own = slice(first, first + some)
            y = np.ascontiguousarray(x[:, own])
            buffer = np.empty((longest, y.shape[1]))
            for at, to, a, b in runs:
                part = np.take(y, v[a:b], axis=0, out=buffer[: b - a], mode="clip")
                part *= c[a:b, None]
                out[nodes[at:to], own] -= np.add.reduceat(part, starts[at:to] - a, axis=0)
        return out

    return times, diagonal


def _conjugate(times, diagonal: np.ndarray, rhs: np.ndarray, rtol: float, atol: float, steps: int, ones: float = 0.0) -> np.ndarray:
    """All right-hand sides at once by Jacobi-preconditioned conjugate gradients; ``ones`` adds that multiple of 11^T."""
    x = np.zeros_like(rhs)
    r = rhs.copy()
    goal = np.maximum(rtol * np.linalg.norm(rhs, axis=0), atol)
    inverse = 1.0 / (diagonal + ones)[:, None]
    z = inverse * r
    p = z.copy()
    rz = (r * z).sum(0)
    for _ in range(steps):
        if np.all(np.linalg.norm(r, axis=0) <= goal):
            return x
        q = times(p) + ones * p.sum(0)
        alpha = rz / np.where((p * q).sum(0) > 0, (p * q).sum(0), np.inf)
        x += alpha * p
        r -= alpha * q
        z = inverse * r
        following = (r * z).sum(0)
        p = z + np.where(rz > 0, following / np.where(rz > 0, rz, 1), 0) * p
        rz = following
    if np.all(np.linalg.norm(r, axis=0) <= goal):
        return x
    raise NotConverged("the conjugate gradients ended above the tolerance")


def conjugate_energies(times, diagonal: np.ndarray, x: np.ndarray, rtol: float = 1e-7, atol: float = 1e-10, steps: int = 10_000) -> float:
    """The sum over the columns of x^T L^+ x, each column being centred first; tiny negative results become 0."""
    x = x - x.mean(0)
    out = float((x * _conjugate(times, diagonal, x, rtol, atol, steps, 1.0 / len(x))).sum())
    if out < -1e-8:
        raise ValueError("the energy is negative")
    return max(out, 0.0)


def _lower_inverse(lower: np.ndarray, least: int = 64) -> np.ndarray:
    """Inverse of a lower triangular matrix by halves, small ones being solved at once."""
    n = len(lower)
    if n <= least:
        return np.linalg.solve(lower, np.eye(n))
    m = n // 2
    out = np.zeros_like(lower)
    out[:m, :m], out[m:, m:] = _lower_inverse(lower[:m, :m], least), _lower_inverse(lower[m:, m:], least)
    out[m:, :m] = -out[m:, m:] @ lower[m:, :m] @ out[:m, :m]
    return out


class Solver:
    """Systems with a connected Laplacian over the nodes 0..n-1, right-hand sides being driver-held columns.

    Few nodes are factored once. Otherwise conjugate gradients multiply with edges held on the driver, up to ``held``
    of them, or left where they are, every step being a job.
    ``grounded`` fixes the last node at 0, which keeps differences between nodes; otherwise 11^T/n is added, which
    gives the pseudo-inverse for centred right-hand sides.
    """

    def __init__(self, conducting: DataFrame, n: int, grounded: bool = False, rtol: float = 1e-7, atol: float = 1e-10, steps: int = 10_000, dense: int = DENSE, held: int = HELD_EDGES) -> None:
        self.n, self.grounded, self.rtol, self.atol, self.steps = n, grounded, rtol, atol, steps
        self.matrix = _dense(conducting, n) if n <= dense else None
        self.inverse, self.held = None, False
        if self.matrix is None and conducting.limit(held + 1).count() <= held:
            self.times, self.diagonal = _held_multiplier(conducting, n)
            self.held = True
        elif self.matrix is None:
            self.times, self.kept = _multiplier(conducting, n)
            degrees = message_edges(conducting).groupBy("source").agg(F.sum("c").alias("d")).toArrow()
            self.diagonal = np.zeros(n)
            self.diagonal[degrees["source"].to_numpy()] = degrees["d"].to_numpy()

    def solve(self, rhs: np.ndarray) -> np.ndarray:
        rhs = np.asarray(rhs, float).reshape(self.n, -1)
        if self.matrix is not None:
            out = np.zeros_like(rhs)
            own = slice(0, self.n - 1) if self.grounded else slice(0, self.n)
            if self.inverse is None:  # made once, however many systems follow
                self.system = self.matrix[own, own] if self.grounded else self.matrix + 1.0 / self.n
                lower = _lower_inverse(np.linalg.cholesky(self.system))
                self.inverse = lower.T @ lower
            x = self.inverse @ rhs[own]
            out[own] = x + self.inverse @ (rhs[own] - self.system @ x)  # one step of refinement
            return out
        if rhs.size > HELD:
            raise ValueError("too many numbers for the driver; use solve_table")
        if not self.grounded:
            return _conjugate(self.times, self.diagonal, rhs, self.rtol, self.atol, self.steps, 1.0 / self.n)
        return grounded_solve(self.times, self.diagonal, rhs, self.rtol, self.steps)


def grounded_solve(times, diagonal: np.ndarray, rhs: np.ndarray, rtol: float, steps: int, atol: float | np.ndarray = 0.0) -> np.ndarray:
    """The system with the last node fixed at 0; ``atol`` may be a number for each column."""
    mask = np.ones((len(rhs), 1))
    mask[-1] = 0
    inner = lambda x: mask * times(mask * x)
    return _conjugate(inner, np.where(diagonal > 0, diagonal, 1.0), rhs * mask, rtol, atol, steps)


def solve_table(conducting: DataFrame, rhs: DataFrame, rtol: float = 1e-7, atol: float = 1e-10, steps: int = 10_000) -> DataFrame:
    """``node_id, value`` solving the centred system for ``rhs`` (node_id, value ARRAY<DOUBLE>), all of it as tables.

    ``rhs`` has a row for every node and sums to zero per axis (else it is centred), so the sums stay zero and
    11^T plays no part. Nothing but sums per axis reaches the driver. Every step is written out.
    """
    width = rhs.select(F.max(F.size("value"))).first()[0]
    axes = range(width)
    doubled = stored(message_edges(conducting), "target")
    degree = doubled.groupBy(F.col("source").alias("node_id")).agg(F.sum("c").alias("d"))
    means = rhs.agg(*[F.avg(F.col("value")[i]) for i in axes]).first()
    start = rhs.join(degree, "node_id").select(
        "node_id", "d", *[F.lit(0.0).alias(f"x{i}") for i in axes], *[(F.col("value")[i] - F.lit(float(means[i]))).alias(f"r{i}") for i in axes]
    )
    state = stored(start.select("*", *[(F.col(f"r{i}") / F.col("d")).alias(f"p{i}") for i in axes]))
    first = state.agg(*[F.sum(F.col(f"r{i}") * F.col(f"p{i}")) for i in axes], *[F.sum(F.col(f"r{i}") ** 2) for i in axes]).first()
    rz, goal = np.array(first[:width], float), np.maximum(rtol * np.sqrt(np.array(first[width:], float)), atol)
    for _ in range(steps):
        sent = doubled.join(state.select(F.col("node_id").alias("target"), *[f"p{i}" for i in axes]), "target")
        sums = sent.groupBy(F.col("source").alias("node_id")).agg(*[F.sum(F.col("c") * F.col(f"p{i}")).alias(f"s{i}") for i in axes])
        moved = stored(state.join(sums, "node_id").select("*", *[(F.col("d") * F.col(f"p{i}") - F.col(f"s{i}")).alias(f"q{i}") for i in axes]))
        pq = np.array(moved.agg(*[F.sum(F.col(f"p{i}") * F.col(f"q{i}")) for i in axes]).first(), float)
        alpha = [float(a) for a in rz / np.where(pq > 0, pq, np.inf)]
        stepped = moved.select(
            "node_id", "d", *[(F.col(f"x{i}") + alpha[i] * F.col(f"p{i}")).alias(f"x{i}") for i in axes], *[(F.col(f"r{i}") - alpha[i] * F.col(f"q{i}")).alias(f"r{i}") for i in axes], *[f"p{i}" for i in axes]
        )
        left = stepped.agg(*[F.sum(F.col(f"r{i}") ** 2 / F.col("d")) for i in axes], *[F.sum(F.col(f"r{i}") ** 2) for i in axes]).first()
        following, size = np.array(left[:width], float), np.sqrt(np.array(left[width:], float))
        beta = [float(b) for b in np.where(rz > 0, following / np.where(rz > 0, rz, 1), 0)]
        rz = following
        after = stored(stepped.select("node_id", "d", *[f"x{i}" for i in axes], *[f"r{i}" for i in axes], *[(F.col(f"r{i}") / F.col("d") + beta[i] * F.col(f"p{i}")).alias(f"p{i}") for i in axes]))
        discard(state)
        discard(moved)
        state = after
        if np.all(size <= goal):
            return state.select("node_id", F.array(*[F.col(f"x{i}") for i in axes]).alias("value"))
    raise NotConverged("the conjugate gradients ended above the tolerance")


def held_values(values: DataFrame, n: int) -> np.ndarray:
    """``values`` (node_id, value) as an array on the driver, rows by node id, missing nodes as zeros."""
    count, width = values.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("value")), F.lit(0))).first()
    if max(n, count) * max(width, 1) > HELD:
        raise ValueError("too many numbers for the driver")
    rows = values.select("node_id", *[F.col("value")[i].alias(f"x{i}") for i in range(width)]).toArrow()
    out, nodes = np.zeros((n, width)), rows["node_id"].to_numpy()
    for i in range(width):
        out[nodes, i] = rows[f"x{i}"].to_numpy()
    return out
