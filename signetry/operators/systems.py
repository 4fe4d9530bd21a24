"""Systems with a large graph's Laplacian that workers solve, the driver getting numbers of a few nodes only."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .laplacian import AT_ONCE, array_multiplier, grounded_solve
from .polarization import AXES

COLUMNS = 16  # of the sketch solved at once by a worker, fewer where these are more than AT_ONCE numbers
AHEAD = 8  # single pairs solved before they are asked for, for each core

_P = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _finished(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _P[1]
    x = (x ^ (x >> np.uint64(29))) * _P[2]
    return x ^ (x >> np.uint64(32))


def hashed_words(source: np.ndarray, target: np.ndarray, seed: int, word: int) -> np.ndarray:
    """``xxhash64(seed, source, target, word)`` as Spark has it, of two integers and between them two longs."""
    x = np.full(1, 42, np.uint64)
    for value, long in ((np.full(1, seed), False), (source, True), (target, True), (np.full(1, word), False)):
        own = value.astype(np.int64).view(np.uint64)
        if long:
            x = x + _P[4] + np.uint64(8) ^ _turned(own * _P[1], 31) * _P[0]
            x = _turned(x, 27) * _P[0] + _P[3]
        else:
            x = x + _P[4] + np.uint64(4) ^ (own & np.uint64(0xFFFFFFFF)) * _P[0]
            x = _turned(x, 23) * _P[1] + _P[2]
        x = _finished(x)
    return x


def with_unit_edges(times, diagonal: np.ndarray, added: np.ndarray):
    """A multiplication and its diagonal after unit edges are added, ``added`` having two rows of ends."""
    if not added.size:
        return times, diagonal
    a, b = added

    def more(x: np.ndarray) -> np.ndarray:
        out, flow = times(x), x[a] - x[b]
        np.add.at(out, a, flow)
        np.subtract.at(out, b, flow)
        return out

    return more, diagonal + np.bincount(added.ravel(), minlength=len(diagonal))


class WorkerSystems:
    """Grounded systems of ``edges``, wanted at ``nodes``; the driver holds the edges while it sends them and no vector.

    ``added`` are unit edges besides, two rows of ends. ``u`` and ``v`` are places in ``nodes``.
    """

    def __init__(self, edges: DataFrame, coordinates: DataFrame, nodes: np.ndarray, n: int, eta: float, rtol: float = 1e-7, steps: int = 10_000) -> None:
        self.coordinates, self.nodes, self.n, self.rtol, self.steps = coordinates, nodes, n, rtol, steps
        self.spark = edges.sparkSession
        self.cores = max(1, self.spark.sparkContext.defaultParallelism)
        marks = [F.coalesce(c, F.lit(False)).alias(k) for k, c in (("friend", F.col("sign") > 0), ("enemy", F.col("sign") < 0))]
        rows = edges.select(F.col("source").cast("int"), F.col("target").cast("int"), *marks).toArrow()
        held = {k: rows[k].to_numpy() for k in rows.column_names}
        del rows
        self.sent = self.spark.sparkContext.broadcast(held | {"eta": eta})

    def close(self) -> None:
        self.sent.unpersist()

    def ahead(self, wanted: int) -> int:
        """Pairs to solve at once if so many will be asked for: whole rounds of all cores."""
        return self.cores * min(AHEAD, -(-wanted // self.cores))

    def potentials(self, prefixes: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float, float]]:
        """For each set of added edges the centred coordinates' and antagonistic signal's solutions, and their energies.

        A task has some axes and goes on from the solution with one set to that with the next.
        """
        sent, n, nodes, rtol, steps = self.sent, self.n, self.nodes, self.rtol, self.steps

        def solved(key: tuple, rows: pa.Table) -> pa.Table:
            held = sent.value
            at, values = rows["node_id"].to_numpy(), rows["value"].combine_chunks()
            z = np.zeros((n, len(values.flatten()) // max(len(values), 1)))
            z[at] = values.flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
            if "pull" not in held:  # once a worker; nodes without a value pull nobody
                known = np.zeros(n, bool)
                known[at] = True
                enemy = held["enemy"] & known[held["source"]] & known[held["target"]]
                held["pull"] = array_multiplier(held["source"][enemy], held["target"][enemy], np.ones(int(enemy.sum())), n)[0]
            times, diagonal = _multiplied(held, n)
            both = np.hstack([z, held["pull"](z)])
            both -= both.mean(0)
            goal, x, k = rtol * np.linalg.norm(both[:-1], axis=0), np.zeros_like(both), z.shape[1]
            out = []
            for number, added in enumerate(prefixes):
                more, degrees = with_unit_edges(times, diagonal, added)
                x += grounded_solve(more, degrees, both - more(x) if number else both, 0.0, steps, goal)
                own = (both * x).sum(0)
                out.append((key[0].as_py(), number, x[nodes, :k].tobytes(), x[nodes, k:].tobytes(), float(own[:k].sum()), float(own[k:].sum())))
            return pa.table(dict(zip(("at", "number", "z", "y", "structural", "antagonistic"), map(list, zip(*out)))), schema=form)

        form = pa.schema([("at", pa.int64()), ("number", pa.int64()), ("z", pa.binary()), ("y", pa.binary()), ("structural", pa.float64()), ("antagonistic", pa.float64())])
        width = self.coordinates.select(F.max(F.size("value"))).first()[0]
        some = max(1, min(AXES, AT_ONCE // n))
        blocks = [F.struct(F.lit(at).cast("bigint").alias("at"), F.slice("value", at + 1, some).alias("value")) for at in range(0, width, some)]
        parts = self.coordinates.select("node_id", F.explode(F.array(*blocks)).alias("b")).select("b.at", "node_id", "b.value")
        parts = parts.repartitionByRange(len(blocks), "at")
        got = parts.groupBy("at").applyInArrow(solved, "at bigint, number bigint, z binary, y binary, structural double, antagonistic double").collect()
        out = []
        for number in range(len(prefixes)):
            own = sorted((r for r in got if r["number"] == number), key=lambda r: r["at"])
            hz, hy = (np.hstack([np.frombuffer(r[k]).reshape(len(nodes), min(some, width - r["at"])) for r in own]) for k in ("z", "y"))
            out.append((hz, hy, sum(r["structural"] for r in own) / width, sum(r["antagonistic"] for r in own) / width))
        return out

    def resistances(self, u: np.ndarray, v: np.ndarray, added: np.ndarray, width: int, seed: int) -> np.ndarray:
        """``R(u, v)`` by the sketch of ``width`` columns whose signs are hashes of edge and column."""
        n, (pu, pv) = self.n, (self.nodes[u], self.nodes[v])

        def column(held: dict, k: int) -> np.ndarray:
            if held.get("word") != (k // 64, seed):
                held["word"], held["bits"] = (k // 64, seed), hashed_words(held["source"], held["target"], seed, k // 64)
            out = np.zeros(n)
            few = hashed_words(*added, seed, k // 64) if added.size else np.zeros(0, np.uint64)
            for source, target, c, bits in ((held["source"], held["target"], _conductances(held), held["bits"]), (*added, np.ones(len(few)), few)):
                part = np.sqrt(c / width)
                part[((bits >> np.uint64(k % 64)) & np.uint64(1)) == 0] *= -1
                out += np.bincount(source, part, n) - np.bincount(target, part, n)
            return out

        def one(held: dict, times, diagonal, columns: list[int]) -> np.ndarray:
            e = grounded_solve(times, diagonal, np.stack([column(held, k) for k in columns], 1), self_rtol, self_steps)
            return ((e[pu] - e[pv]) ** 2).sum(1)

        self_rtol, self_steps = self.rtol, self.steps
        return np.maximum(sum(self._solved(one, range(width), added)), 1e-12)

    def incidences(self, u: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
        """At the nodes, the solution for each pair's incidence vector."""
        n, nodes, pairs, self_rtol, self_steps = self.n, self.nodes, np.stack([self.nodes[u], self.nodes[v]]), self.rtol, self.steps

        def one(held: dict, times, diagonal, columns: list[int]) -> np.ndarray:
            rhs, at = np.zeros((n, len(columns))), np.arange(len(columns))
            rhs[pairs[0, columns], at], rhs[pairs[1, columns], at] = 1.0, -1.0
            return grounded_solve(times, diagonal, rhs, self_rtol, self_steps)[nodes].T

        return list(np.vstack([x.reshape(-1, len(nodes)) for x in self._solved(one, range(pairs.shape[1]), np.zeros((2, 0), np.int64))]))

    def _solved(self, one, columns: range, added: np.ndarray) -> list[np.ndarray]:
        """What ``one`` gives for some columns at a time, dealt evenly to the workers, in the columns' order."""
        sent, n = self.sent, self.n
        rounds = -(-len(columns) // (self.cores * max(1, min(COLUMNS, AT_ONCE // n))))
        some = -(-len(columns) // (self.cores * rounds))
        parts = [list(columns[k : k + some]) for k in range(0, len(columns), some)]

        def solved(frames):
            held = sent.value
            times, diagonal = with_unit_edges(*_multiplied(held, n), added)
            for number in (int(i) for frame in frames for i in frame["part"]):
                yield pd.DataFrame({"part": [number], "data": [np.ascontiguousarray(one(held, times, diagonal, parts[number])).tobytes()]})

        tasks = self.spark.createDataFrame([(i,) for i in range(len(parts))], "part int").repartitionByRange(len(parts), "part")
        got = tasks.mapInPandas(solved, "part int, data binary").collect()
        return [np.frombuffer(r["data"]) for r in sorted(got, key=lambda r: r["part"])]


def _conductances(held: dict) -> np.ndarray:
    return np.where(held["friend"], 1.0, held["eta"])


def _multiplied(held: dict, n: int):
    if "times" not in held:  # once a worker
        held["times"] = array_multiplier(held["source"], held["target"], _conductances(held), n)
    return held["times"]
