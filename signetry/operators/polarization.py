"""Opinion coordinates and the polarization of a signed graph as an effective-resistance energy."""

from __future__ import annotations

import math

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import FLOOR
from .laplacian import AT_ONCE, DENSE, HELD, Solver, array_multiplier, check_nodes, conjugate_energies, held_values, negative_layer, quadratic_form, solve_table, spread_values, weighted_edges

WORKER_EDGES = 20_000_000  # that a worker multiplies with
AXES = 4  # solved at once by a worker, fewer where these are more than AT_ONCE numbers
NEGATIVE_CONDUCTANCE = 0.1
ANTAGONISTIC_WEIGHT = 0.05


def gram(state: DataFrame) -> DataFrame:
    """``i, j, total`` with i <= j of the uncentred Gram matrix of ``state`` (node_id, state), and -1, j for column sums.

    Every partition adds up its rows in one matrix; only matrices of the vectors' width are shuffled.
    """

    def partial(frames):
        sums = None
        for frame in frames:
            if len(frame):
                x = np.array(frame["state"].tolist(), float)
                own = np.vstack([x.sum(0), x.T @ x])
                sums = own if sums is None else sums + own
        if sums is not None:
            i, j = np.meshgrid(np.arange(-1, sums.shape[0] - 1), np.arange(sums.shape[1]), indexing="ij")
            keep = i <= j
            yield pd.DataFrame({"i": i[keep], "j": j[keep], "total": sums[keep]})

    return state.select("state").mapInPandas(partial, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total"))


def _principal(state: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column means, the first k right singular vectors of the centred state, and their singular values."""
    n, bad = state.agg(F.count(F.lit(1)), F.count_if(F.exists("state", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))).first()
    rows = gram(state).collect()
    d = max((r["j"] for r in rows), default=-1) + 1
    if bad or not 1 <= k <= min(n, d):
        raise ValueError("the state must be finite and k between 1 and the smaller of its sides")
    total, matrix = np.zeros(d), np.zeros((d, d))
    for r in rows:
        if r["i"] < 0:
            total[r["j"]] = r["total"]
        else:
            matrix[r["i"], r["j"]] = matrix[r["j"], r["i"]] = r["total"]
    mean = total / n
    values, vectors = np.linalg.eigh(matrix - n * np.outer(mean, mean))
    order = np.argsort(values)[::-1][:k]
    return mean, vectors[:, order], np.sqrt(np.maximum(values[order], 0))


def opinion_coordinates(state: DataFrame, k: int, normalize: bool = True, project: bool = True) -> tuple[DataFrame, np.ndarray]:
    """``node_id, value``: the centred state on its first k principal directions, rows scaled to unit length.

    Rows shorter than a tiny floor are divided by the floor. The singular values are returned beside it. The sign
    of an axis is arbitrary; no result built on it depends on the sign.
    """
    if project:
        mean, vectors, singular = _principal(state, k)
    else:
        mean, vectors, singular = np.zeros(0), np.zeros((0, 0)), np.zeros(0)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def coordinates(rows: pd.Series) -> pd.Series:
        x = np.array(rows.tolist(), float)
        if project:
            x = (x - mean) @ vectors
        if normalize:
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), FLOOR)
        return pd.Series(list(x))

    return state.select("node_id", coordinates("state").alias("value")), singular


def antagonistic_signal(edges: DataFrame, coordinates: DataFrame) -> DataFrame:
    """``node_id, value``: the negative layer's Laplacian times the coordinates; nodes without enemies get zeros."""
    width = coordinates.select(F.max(F.size("value"))).first()[0] or 0
    pulled = spread_values(negative_layer(edges), coordinates)
    zeros = F.array(*[F.lit(0.0)] * width)
    return coordinates.select("node_id").join(pulled, "node_id", "left").select("node_id", F.coalesce("value", zeros).alias("value"))


def energy(solver: Solver, x: np.ndarray) -> float:
    """Mean over the axes of x^T L^+ x, each axis being centred first; tiny negative results become 0."""
    x = np.asarray(x, float).reshape(len(x), -1)
    centred = x - x.mean(0)
    out = float((centred * solver.solve(centred)).sum() / x.shape[1])
    if out < -1e-8:
        raise ValueError("the energy is negative")
    return max(out, 0.0)


def energy_table(conducting: DataFrame, values: DataFrame) -> float:
    """``energy`` without holding a vector on the driver."""
    width = values.select(F.max(F.size("value"))).first()[0]
    solved = solve_table(conducting, values).withColumnRenamed("value", "solved")
    products = [F.sum(F.col("value")[i] * F.col("solved")[i]) for i in range(width)]
    return max(float(sum(values.join(solved, "node_id").agg(*products).first())) / width, 0.0)


def score(structural: float, antagonistic: float, alpha: float = ANTAGONISTIC_WEIGHT) -> float:
    if alpha < 0:
        raise ValueError("the antagonistic weight must not be negative")
    return math.sqrt(max(structural + alpha * antagonistic, 0.0))


def worker_energies(edges: DataFrame, coordinates: dict[str, DataFrame], n: int, positive: float, eta: float) -> dict[str, tuple[float, float]]:
    """Structural and antagonistic energy of each of several coordinates (node_id, value), all in one job.

    The driver holds the edges once and no vector. Workers take some axes each, form their antagonistic signal and
    solve the systems of both.
    """
    spark = edges.sparkSession
    rows = edges.select(F.col("source").cast("int"), F.col("target").cast("int"), (F.col("sign") > 0).alias("friend"), (F.col("sign") < 0).alias("enemy")).toArrow()
    held = {k: rows[k].to_numpy() for k in ("source", "target", "friend", "enemy")}
    del rows
    sent = spark.sparkContext.broadcast(held)
    some = max(1, min(AXES, AT_ONCE // n))

    def solved(key: tuple, rows: pa.Table) -> pa.Table:
        held = sent.value
        if "times" not in held:  # once a worker
            source, target, enemy = held["source"], held["target"], held["enemy"]
            held["times"] = array_multiplier(source, target, np.where(held["friend"], positive, eta), n)
            held["pull"] = array_multiplier(source[enemy], target[enemy], np.ones(int(enemy.sum())), n)[0]
        nodes, values = rows["node_id"].to_numpy(), rows["value"].combine_chunks()
        z = np.zeros((n, len(values.flatten()) // max(len(values), 1)))
        z[nodes] = values.flatten().to_numpy(zero_copy_only=False).reshape(len(nodes), -1)
        out = [conjugate_energies(*held["times"], x) for x in (z, held["pull"](z))]
        return pa.table({"name": [key[0].as_py()], "axes": [z.shape[1]], "structural": [out[0]], "antagonistic": [out[1]]})

    widths = {k: v.select(F.max(F.size("value"))).first()[0] for k, v in coordinates.items()}
    parts = []
    for name, values in coordinates.items():
        blocks = [F.struct(F.lit(at).alias("at"), F.slice("value", at + 1, some).alias("value")) for at in range(0, widths[name], some)]
        parts.append(values.select("node_id", F.explode(F.array(*blocks)).alias("b")).select(F.lit(name).alias("name"), "b.at", "node_id", "b.value"))
    grouped = reduce(DataFrame.unionByName, parts).groupBy("name", "at")
    got = grouped.applyInArrow(solved, "name string, axes bigint, structural double, antagonistic double").collect()
    sent.unpersist()
    mean = lambda name, kind: sum(r[kind] for r in got if r["name"] == name) / widths[name]
    return {name: (mean(name, "structural"), mean(name, "antagonistic")) for name in coordinates}


def energies(edges: DataFrame, coordinates: dict[str, DataFrame], n: int, positive: float = 1.0, eta: float = NEGATIVE_CONDUCTANCE) -> dict[str, tuple[float, float]]:
    """Structural and antagonistic energy of each of several coordinates: factored, by workers, or as tables."""
    if n > DENSE and edges.limit(WORKER_EDGES + 1).count() <= WORKER_EDGES and n <= HELD:
        return worker_energies(edges, coordinates, n, positive, eta)
    conducting, out = weighted_edges(edges, positive, eta), {}
    solver = Solver(conducting, n) if n <= DENSE else None
    for name, values in coordinates.items():
        both = (values, antagonistic_signal(edges, values))
        out[name] = tuple(energy(solver, held_values(x, n)) if solver else energy_table(conducting, x) for x in both)
    return out


def energy_components(edges: DataFrame, coordinates: DataFrame, n: int, positive: float = 1.0, eta: float = NEGATIVE_CONDUCTANCE, alpha: float = ANTAGONISTIC_WEIGHT, checked: bool = False, found: tuple[float, float] | None = None) -> dict:
    """The record of one measurement: sizes, energies, scores and parameters; ``found`` are energies known already."""
    if not checked:
        check_nodes(edges, n)
    k = coordinates.select(F.max(F.size("value"))).first()[0]
    structural, antagonistic = found or energies(edges, {"": coordinates}, n, positive, eta)[""]
    counts = edges.agg(F.count(F.lit(1)), F.count_if(F.col("sign") > 0), F.count_if(F.col("sign") < 0)).first()
    return {
        "num_nodes": n,
        "num_edges": counts[0],
        "positive_edges": counts[1],
        "negative_edges": counts[2],
        "negative_prevalence": counts[2] / counts[0],
        "dimension": k,
        "structural_energy": structural,
        "antagonistic_energy": antagonistic,
        "structural_score": math.sqrt(structural),
        "polarization": score(structural, antagonistic, alpha),
        "negative_conductance": eta,
        "antagonistic_weight": alpha,
    }


def measure(edges: DataFrame, state: DataFrame, k: int, eta: float = NEGATIVE_CONDUCTANCE, alpha: float = ANTAGONISTIC_WEIGHT, checked: bool = False) -> DataFrame:
    """One row with the energies and the score of a canonical graph and the node state (node_id, state).

    ``checked`` says that the graph is known to be connected over the nodes 0..n-1.
    """
    n = state.count()
    coordinates, singular = opinion_coordinates(state, k)
    record = energy_components(edges, coordinates, n, eta=eta, alpha=alpha, checked=checked) | {"top_singular_value": float(singular[0])}
    schema = ", ".join(f"{name} {'bigint' if isinstance(v, int) else 'double'}" for name, v in record.items())
    return edges.sparkSession.createDataFrame([tuple(record.values())], schema)


def sensitivity(edges: DataFrame, state: DataFrame, selected_k: int, eta: float = NEGATIVE_CONDUCTANCE, alpha: float = ANTAGONISTIC_WEIGHT, checked: bool = False) -> DataFrame:
    """``variant, k, ...``: the measurement without projection, without scaling, and for several k up to the width."""
    n = state.count()
    width = state.select(F.max(F.size("state"))).first()[0]
    if not checked:
        check_nodes(edges, n)
    plan = [("projected_scaled", selected_k, True, True), ("scaled_only", width, True, False), ("projected_only", selected_k, False, True)]
    plan += [("dimension", k, True, True) for k in sorted({min(k, width, n) for k in (2, 4, 8, 16, 32)})]
    states = {}
    for _, k, scaled, project in plan:
        how = (min(k, width, n), scaled, project)
        states[how] = states.get(how) or opinion_coordinates(state, *how)[0]
    names = {how: str(i) for i, how in enumerate(states)}
    found = energies(edges, {names[how]: values for how, values in states.items()}, n, eta=eta)
    rows = []
    for variant, k, scaled, project in plan:
        structural, antagonistic = found[names[min(k, width, n), scaled, project]]
        rows.append((variant, min(k, width, n) if project else width, structural, antagonistic, score(structural, antagonistic, alpha)))
    return edges.sparkSession.createDataFrame(rows, "variant string, k int, structural_energy double, antagonistic_energy double, polarization double")


def er_baseline(edges: DataFrame, opinions: DataFrame, n: int) -> float:
    """Polarization of one-dimensional opinions (node_id, opinion) over the positive layer with unit conductance."""
    low, high = opinions.agg(F.min("opinion"), F.max("opinion")).first()
    if low is None or not low < 0 < high:
        raise ValueError("the opinions must have both signs")
    positive = edges.where("sign > 0")
    check_nodes(positive, n)
    values = opinions.select("node_id", F.array(F.col("opinion").cast("double")).alias("value"))
    return math.sqrt(energy(Solver(weighted_edges(positive), n), held_values(values, n)))


def dirichlet_energy(edges: DataFrame, coordinates: DataFrame, eta: float = NEGATIVE_CONDUCTANCE) -> DataFrame:
    """The plain quadratic form of the weighted Laplacian, which needs no solve."""
    return quadratic_form(weighted_edges(edges, 1.0, eta), coordinates)
