"""Where to add positive edges: communities, gray zones, candidates, greedy choice, augmentation."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hash_key, pair_high, pair_low, vec_sqdist
from ..session import stored
from .laplacian import AT_ONCE, DENSE, HELD, Solver, array_multiplier, grounded_solve, held_values, weighted_edges
from .polarization import ANTAGONISTIC_WEIGHT, WORKER_EDGES, antagonistic_signal
from .systems import WorkerSystems

PAIRS = 20_000  # community pairs at most, so that they may be broadcast
EXACT_UNION = 20_000_000
PROPOSALS = 1_000_000  # at least, and 1000 for each wanted candidate
STARTED = 3  # starts of k-means that Spark chooses at a time
RUN_TASKS = 5  # workers that deal the runs of k-means among them
SKETCH = 128
SKETCH_SEED = 2026
NONE = np.zeros((2, 0), np.int64)  # no added edges
CANDIDATE_COLUMNS = ("source", "target", "community_1", "community_2", "edge_type")


# ---------------------------------------------------------------------------------- communities and gray zones
def kmeans_communities(state: DataFrame, k: int, seed: int = 42, restarts: int = 10) -> DataFrame:
    """``node_id, community`` of the cheapest of several k-means runs over the raw state.

    Spark chooses the starts. Up to HELD numbers workers that hold all rows go on from some of them each, with
    arrays, by the steps and the end that Spark's fit has; beyond that Spark fits them one after the other.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = stored(state.select("node_id", array_to_vector(F.col("state").cast("array<double>")).alias("features")))
    runs = [KMeans(k=k, seed=seed + i, featuresCol="features", predictionCol="community") for i in range(restarts)]
    width = len(first["state"]) if (first := state.select("state").first()) else 0
    if rows.count() * width > HELD:
        models = [run.fit(rows) for run in runs]
        best = min(models, key=lambda m: m.summary.trainingCost)
        return best.transform(rows).select("node_id", "community")
    with ThreadPoolExecutor(STARTED) as pool:
        starts = list(pool.map(inheritable_thread_target(state.sparkSession)(lambda run: np.array(run.copy({run.maxIter: 0}).fit(rows).clusterCenters())), runs))
    steps, end, workers = runs[0].getMaxIter(), runs[0].getTol() ** 2, min(restarts, RUN_TASKS)

    def cluster(batches):
        ids, parts, own = [], [], 0
        for batch in batches:
            own = batch.column(0)[0].as_py() if len(batch) else own
            ids.append(batch.column(1).to_numpy())
            parts.append(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
        if not sum(map(len, ids)):
            return
        label, run, cost = _cheapest(np.concatenate(parts), starts[own::workers], steps, end)
        n = len(label)
        yield pa.record_batch({"node_id": np.concatenate(ids), "community": label.astype(np.int32), "run": np.full(n, own + run * workers), "cost": np.full(n, cost)})

    every = state.select(F.explode(F.array(*map(F.lit, range(workers)))).alias("own"), F.col("node_id").cast("bigint"), F.col("state").cast("array<double>"))
    found = stored(every.repartitionById(workers, F.col("own")).mapInArrow(cluster, "node_id bigint, community int, run bigint, cost double"))
    best = found.agg(F.min(F.struct("cost", "run"))).first()[0]
    return found.where(F.col("run") == (best["run"] if best else 0)).select("node_id", "community")


def _cheapest(x: np.ndarray, starts: list[np.ndarray], steps: int, end: float) -> tuple[np.ndarray, int, float]:
    """Number of the nearest centre of each row, of the run that was cheapest at its last step; that run and its cost.

    A run ends when none of its centres moves further than the root of ``end``; a centre without rows stays.
    """
    centres, cost, going = [c.copy() for c in starts], [np.inf] * len(starts), list(range(len(starts)))
    squares = (x * x).sum(1)

    def nearest(rows: slice, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        away = (c * c).sum(1) - 2 * (x[rows] @ c.T)
        label = away.argmin(1)
        return label, np.maximum(away[np.arange(len(label)), label] + squares[rows], 0)

    for _ in range(steps):
        if not going:
            break
        sums, sizes = {r: np.zeros_like(centres[r]) for r in going}, {r: np.zeros(len(centres[r])) for r in going}
        cost = [0.0 if r in going else v for r, v in enumerate(cost)]
        for at in range(0, len(x), 8_192):
            rows = slice(at, at + 8_192)
            for r in going:
                label, away = nearest(rows, centres[r])
                one = np.zeros((len(label), len(centres[r])))
                one[np.arange(len(label)), label] = 1
                sums[r] += one.T @ x[rows]
                sizes[r] += one.sum(0)
                cost[r] += away.sum()
        still = []
        for r in going:
            own = sizes[r] > 0
            moved = sums[r][own] / sizes[r][own][:, None]
            if (((moved - centres[r][own]) ** 2).sum(1) > end).any():
                still.append(r)
            centres[r][own] = moved
        going = still
    run = int(np.argmin(cost))
    label = np.concatenate([nearest(slice(at, at + 8_192), centres[run])[0] for at in range(0, len(x), 8_192)])
    return label, run, float(cost[run])


def retained(partition: DataFrame, minimum_size: int) -> DataFrame:
    """``community, size`` of the communities of at least that size; fewer than two raise an error."""
    sizes = partition.groupBy("community").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= minimum_size)
    if sizes.limit(2).count() < 2:
        raise ValueError("fewer than two communities are large enough")
    return sizes


def community_pairs(sizes: DataFrame) -> DataFrame:
    """``community_1 < community_2`` with their sizes, for all pairs of retained communities."""
    if (n := sizes.count()) * (n - 1) // 2 > PAIRS:
        raise ValueError("too many communities")
    one = sizes.select(F.col("community").alias("community_1"), F.col("size").alias("size_c1"))
    two = sizes.select(F.col("community").alias("community_2"), F.col("size").alias("size_c2"))
    return one.join(F.broadcast(two), F.col("community_1") < F.col("community_2"))


def centroids(coordinates: DataFrame, partition: DataFrame) -> DataFrame:
    """``community, axis, mean``: the mean coordinates of each community, one row per axis."""
    long = coordinates.join(partition, "node_id").select("community", F.posexplode("value").alias("axis", "x"))
    return long.groupBy("community", "axis").agg(F.avg("x").alias("mean"))


def gray_ranking(coordinates: DataFrame, partition: DataFrame, minimum_size: int) -> DataFrame:
    """``community_1, community_2, node_id, score, rank``: for each pair the nodes of neither that lie between them.

    The score is the difference of the distances to the two centroids plus the larger one; the lowest come first.
    As many nodes are kept for every pair as a retained community has on average, rounded up.
    """
    sizes = stored(retained(partition, minimum_size))
    keep = math.ceil(sizes.agg(F.avg("size")).first()[0])
    axes = centroids(coordinates, partition.join(F.broadcast(sizes.select("community")), "community", "left_semi"))
    centre = axes.groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("axis", "mean"))), lambda x: x["mean"]).alias("centre"))
    pairs = community_pairs(sizes)
    pairs = pairs.join(centre.select(F.col("community").alias("community_1"), F.col("centre").alias("left")), "community_1")
    pairs = pairs.join(centre.select(F.col("community").alias("community_2"), F.col("centre").alias("right")), "community_2")
    nodes = coordinates.join(partition, "node_id")
    # the pairs are few (checked above) and a fixed set that every node is held against
    eligible = nodes.join(F.broadcast(pairs), (F.col("community") != F.col("community_1")) & (F.col("community") != F.col("community_2")))
    a, b = F.sqrt(vec_sqdist(F.col("value"), F.col("left"))), F.sqrt(vec_sqdist(F.col("value"), F.col("right")))
    scored = eligible.select("community_1", "community_2", "node_id", (F.abs(a - b) + F.greatest(a, b)).alias("score"))
    rank = F.row_number().over(Window.partitionBy("community_1", "community_2").orderBy(F.round("score", 9), "node_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= keep)


def gray_contexts(gray: DataFrame, partition: DataFrame) -> DataFrame:
    """All contexts of all candidate edges: both ends gray, or one gray and the other in one of the two communities."""
    g = gray.select("community_1", "community_2", F.col("node_id").alias("g"))
    h = gray.select("community_1", "community_2", F.col("node_id").alias("h"))
    keys = ["community_1", "community_2"]
    both = g.join(h, keys).where("g < h").select(F.col("g").alias("source"), F.col("h").alias("target"), *keys, F.lit("gray_gray").alias("edge_type"))
    out = both
    for column, name in (("community_1", "community_1_gray"), ("community_2", "gray_community_2")):
        members = partition.select(F.col("community").alias(column), F.col("node_id").alias("h"))
        ends = g.join(members, column).where("g <> h")
        out = out.unionByName(ends.select(F.least("g", "h").alias("source"), F.greatest("g", "h").alias("target"), *keys, F.lit(name).alias("edge_type")))
    return out.distinct()


def candidate_pool(gray: DataFrame, partition: DataFrame, occupied: DataFrame, cap: int, seed: int, exact: int = EXACT_UNION) -> DataFrame:
    """``source, target, community_1, community_2, edge_type, sample_rank``: a uniform sample of the free candidate edges.

    As long as the contexts number at most ``exact`` they are all made and the pairs ordered by a hash. For a larger
    union node pairs are proposed by hashes, joined to their gray zones, and those with a context kept, in rounds
    until ``cap`` are free; only if the proposals end before that the union is made after all. Each pair has one of
    its contexts, chosen by a hash.
    """
    taken = occupied.select(pair_low().alias("source"), pair_high().alias("target")).distinct()
    n_gray = gray.groupBy("community_1", "community_2").agg(F.count(F.lit(1)).alias("g"))
    sizes = partition.groupBy("community").agg(F.count(F.lit(1)).alias("s"))
    a, b = sizes.select(F.col("community").alias("community_1"), F.col("s").alias("s1")), sizes.select(F.col("community").alias("community_2"), F.col("s").alias("s2"))
    union = n_gray.join(a, "community_1").join(b, "community_2").agg(F.sum(F.col("g") * (F.col("g") / 2 + F.col("s1") + F.col("s2")))).first()[0] or 0
    key = hash_key(f"{seed}|context", "source", "target", "community_1", "community_2", "edge_type")

    def free(contexts: DataFrame) -> DataFrame:
        chosen = contexts.groupBy("source", "target").agg(F.min_by(F.struct("community_1", "community_2", "edge_type"), key).alias("c")).select("source", "target", "c.*")
        return chosen.join(taken, ["source", "target"], "left_anti").withColumn("__key", hash_key(seed, "source", "target"))

    pool = None
    start, stop, most = 0, 50 * cap, max(PROPOSALS, 1000 * cap)
    while union > exact:
        drawn = free(_proposed_contexts(gray, partition, start, stop, seed))
        pool = stored(drawn if pool is None else pool.unionByName(drawn).distinct())
        if pool.count() >= cap:
            break
        if stop >= most:
            pool = None
            break
        start, stop = stop, min(2 * stop, most)
    if pool is None:
        pool = free(gray_contexts(gray, partition))
    first = pool.orderBy("__key", "source", "target").limit(cap)
    rank = F.row_number().over(Window.orderBy("__key", "source", "target"))  # at most cap rows
    return first.withColumn("sample_rank", rank).drop("__key")


def _proposed_contexts(gray: DataFrame, partition: DataFrame, start: int, stop: int, seed: int) -> DataFrame:
    """Contexts of the hashed node pairs ``start`` to ``stop``."""
    n = partition.count()
    spark = partition.sparkSession
    pick = lambda salt: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(n))
    drawn = spark.range(start, stop).select(F.least(pick(1), pick(2)).alias("source"), F.greatest(pick(1), pick(2)).alias("target")).where("source < target").distinct()
    keys = ["community_1", "community_2"]
    out = None
    for g, h in (("source", "target"), ("target", "source")):
        zone = gray.select(*keys, F.col("node_id").alias(g))
        home = partition.select(F.col("node_id").alias(h), F.col("community").alias("home"))
        other = gray.select(*keys, F.col("node_id").alias(h), F.lit(True).alias("also"))
        near = drawn.join(zone, g).join(home, h).join(other, [h, *keys], "left")
        kind = F.when(F.col("also"), "gray_gray").when(F.col("home") == F.col("community_1"), "community_1_gray").when(F.col("home") == F.col("community_2"), "gray_community_2")
        own = near.select("source", "target", *keys, kind.alias("edge_type")).where("edge_type is not null")
        out = own if out is None else out.unionByName(own)
    return out.distinct()


def non_edges(num_nodes: int, occupied: DataFrame, count: int, seed: int | str, small: int = 4_000, strict: bool = True) -> DataFrame:
    """``source, target, sample_rank``: ``count`` node pairs without an edge in a hashed order, without replacement.

    Asking for more than there are raises an error, or without ``strict`` gives all there are. Small node sets order
    all their free pairs; large ones draw pairs by hashes, four times as many again while too few of them are free,
    and keep the first free ones.
    """
    spark = occupied.sparkSession
    taken = occupied.select(pair_low().alias("source"), pair_high().alias("target")).where("source <> target").distinct()
    if num_nodes <= small:
        nodes = spark.range(num_nodes)
        free = nodes.select(F.col("id").alias("source"), F.explode(F.sequence(F.col("id") + 1, F.lit(num_nodes))).alias("target")).where(F.col("target") < num_nodes)
    else:
        open_ = num_nodes * (num_nodes - 1) // 2 - taken.count()
        if open_ < count and strict:
            raise ValueError(f"only {open_} of {count} pairs are free")
        count = min(count, open_)
        pick = lambda salt: F.pmod(F.xxhash64("id", F.lit(str(seed)), F.lit(salt)), F.lit(num_nodes))
        draws = 2 * count + 1000
        while True:
            drawn = spark.range(draws).select(F.least(pick(1), pick(2)).alias("source"), F.greatest(pick(1), pick(2)).alias("target")).where("source < target").distinct()
            if draws > 8 * num_nodes * num_nodes:  # nearly all pairs are taken, or wanted
                nodes = spark.range(num_nodes)
                drawn = nodes.select(F.col("id").alias("source"), F.explode(F.sequence(F.col("id") + 1, F.lit(num_nodes))).alias("target")).where(F.col("target") < num_nodes)
                break
            if drawn.join(taken, ["source", "target"], "left_anti").count() >= count:
                break
            draws *= 4
        free = drawn
    free = free.join(taken, ["source", "target"], "left_anti").withColumn("__key", hash_key(seed, "source", "target"))
    out = free.orderBy("__key", "source", "target").limit(count)
    ranked = stored(out.withColumn("sample_rank", F.row_number().over(Window.orderBy("__key", "source", "target"))).drop("__key"))
    if strict and (got := ranked.count()) < count:
        raise ValueError(f"only {got} of {count} pairs are free")
    return ranked


# ---------------------------------------------------------------------------------- greedy choice
def check_candidates(candidates: DataFrame, num_nodes: int) -> None:
    """Raise unless the pool is not empty, canonical, within the node range and free of repetitions."""
    n, distinct, bad = candidates.agg(
        F.count(F.lit(1)), F.countDistinct("source", "target"), F.count_if((F.col("source") >= F.col("target")) | (F.col("source") < 0) | (F.col("target") >= num_nodes))
    ).first()
    if not n or distinct != n or bad:
        raise ValueError("candidates must be canonical, in range, unique and not empty")


def _sketch_signs(conducting: DataFrame, width: int, seed: int) -> DataFrame:
    """The edges with the words ``h0, h1, ...`` whose bits are the signs of the sketch's columns."""
    return conducting.select("source", "target", "c", *[F.xxhash64(F.lit(seed), "source", "target", F.lit(k)).alias(f"h{k}") for k in range(-(-width // 64))])


def resistance_sketch(conducting: DataFrame, solver: Solver, width: int = SKETCH, seed: int = SKETCH_SEED, columns: range | None = None) -> np.ndarray:
    """Random projections e with R(u, v) close to |e_u - e_v|^2; the signs come from hashes of edge and column.

    ``columns`` are those wanted of the ``width`` there are.
    """
    n, columns = solver.n, columns or range(width)
    own = len(columns)
    if n * own > HELD:
        raise ValueError("too many numbers for the driver")
    hashed = _sketch_signs(conducting, width, seed)

    def partial(frames):
        total = np.zeros((n, own))
        for f in frames:
            bits = np.stack([(f[f"h{k // 64}"].to_numpy() >> (k % 64)) & 1 for k in columns], axis=1)
            part = (2.0 * bits - 1) * np.sqrt(f["c"].to_numpy() / width)[:, None]
            np.add.at(total, f["source"].to_numpy(), part)
            np.add.at(total, f["target"].to_numpy(), -part)
        yield pd.DataFrame({"key": [0], "data": [total.tobytes()]})

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": [0], "data": [sum(np.frombuffer(d) for d in frame["data"]).tobytes()]})

    few = hashed.coalesce(8)
    rows = few.mapInPandas(partial, "key int, data binary").groupBy("key").applyInPandas(added, "key int, data binary").collect()
    return solver.solve(np.frombuffer(rows[0]["data"]).reshape(n, own))


def pair_resistances(conducting: DataFrame, solver: Solver, u: np.ndarray, v: np.ndarray, width: int = SKETCH, seed: int = SKETCH_SEED, at_once: int = AT_ONCE) -> np.ndarray:
    """``R(u, v)`` of pairs by the sketch, of which no more columns are held at a time than ``at_once`` numbers.

    Where the solver holds its edges the columns are solved by workers, which send back a number for each pair.
    """
    n = solver.n
    if solver.matrix is not None:
        sketch = resistance_sketch(conducting, solver, width, seed)
        return np.maximum(((sketch[u] - sketch[v]) ** 2).sum(1), 1e-12)
    some = max(1, min(16, at_once // n))
    parts = [range(k, min(k + some, width)) for k in range(0, width, some)]
    if not solver.held:
        out = np.zeros(len(u))
        for columns in parts:
            sketch = resistance_sketch(conducting, solver, width, seed, columns)
            out += ((sketch[u] - sketch[v]) ** 2).sum(1)
        return np.maximum(out, 1e-12)
    rows = _sketch_signs(conducting, width, seed).toArrow()
    arrays = [rows[k].to_numpy() for k in rows.column_names]
    arrays[:2] = [x.astype(np.int32) for x in arrays[:2]]
    del rows
    spark, rtol, steps = conducting.sparkSession, solver.rtol, solver.steps
    sent = spark.sparkContext.broadcast((arrays, u, v))

    def solved(frames):
        (source, target, c, *words), pu, pv = sent.value
        times, diagonal = array_multiplier(source, target, c, n)
        for number in (int(i) for frame in frames for i in frame["part"]):
            rhs = np.zeros((n, len(parts[number])))
            for i, k in enumerate(parts[number]):
                part = (2.0 * ((words[k // 64] >> (k % 64)) & 1) - 1) * np.sqrt(c / width)
                rhs[:, i] = np.bincount(source, part, n) - np.bincount(target, part, n)
            e = grounded_solve(times, diagonal, rhs, rtol, steps)
            yield pd.DataFrame({"part": [number], "data": [((e[pu] - e[pv]) ** 2).sum(1).tobytes()]})

    tasks = spark.createDataFrame([(i,) for i in range(len(parts))], "part int").repartitionByRange(len(parts), "part")
    got = tasks.mapInPandas(solved, "part int, data binary").collect()
    sent.unpersist()
    return np.maximum(sum(np.frombuffer(r["data"]) for r in sorted(got, key=lambda r: r["part"])), 1e-12)


def _potentials(solver: Solver, z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solutions for both centred blocks of columns, solved together where the driver may hold both."""
    if z.size + y.size > HELD:
        return solver.solve(z - z.mean(0)), solver.solve(y - y.mean(0))
    both = solver.solve(np.hstack([z - z.mean(0), y - y.mean(0)]))
    return both[:, : z.shape[1]].copy(), both[:, z.shape[1] :].copy()


def edge_gains(hz: np.ndarray, hy: np.ndarray, resistance: np.ndarray, source: np.ndarray, target: np.ndarray, alpha: float) -> np.ndarray:
    """What adding each edge takes off the energy."""
    dz, dy = hz[source] - hz[target], hy[source] - hy[target]
    return ((dz * dz).sum(1) + alpha * (dy * dy).sum(1)) / (hz.shape[1] * (1.0 + resistance))


def rank_one_update(action: np.ndarray, incidence: np.ndarray, source: int, target: int, denominator: float) -> np.ndarray:
    """The inverse applied to the same columns after a unit edge is added, ``incidence`` being its own inverse action."""
    if denominator <= 0:
        raise ValueError("the denominator must be positive")
    return action - np.outer(incidence, action[source] - action[target]) / denominator


class HeldSystems:
    """``WorkerSystems`` for few nodes, or more edges than a worker takes, by a solver whose vectors the driver holds."""

    def __init__(self, edges: DataFrame, coordinates: DataFrame, nodes: np.ndarray, n: int, eta: float, rtol: float) -> None:
        self.base, self.nodes, self.n, self.rtol = weighted_edges(edges, 1.0, eta), nodes, n, rtol
        self.z, self.y = held_values(coordinates, n), held_values(antagonistic_signal(edges, coordinates), n)
        self._solver(NONE)

    def close(self) -> None:
        pass

    def ahead(self, wanted: int) -> int:
        return 1

    def _solver(self, added: np.ndarray) -> Solver:
        if not hasattr(self, "added") or not np.array_equal(self.added, added):
            self.added, self.conducting = added, self.base
            if added.size:
                rows = self.base.sparkSession.createDataFrame([(int(a), int(b), 1.0) for a, b in added.T], "source bigint, target bigint, c double")
                self.conducting = stored(self.base.unionByName(rows))
            self.solver = Solver(self.conducting, self.n, grounded=True, rtol=self.rtol)
        return self.solver

    def potentials(self, prefixes: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float, float]]:
        out = []
        for added in prefixes:
            hz, hy = _potentials(self._solver(added), self.z, self.y)
            own = [float(((x - x.mean(0)) * h).sum()) / x.shape[1] for x, h in ((self.z, hz), (self.y, hy))]
            out.append((hz[self.nodes], hy[self.nodes], *own))
        return out

    def resistances(self, u: np.ndarray, v: np.ndarray, added: np.ndarray, width: int, seed: int) -> np.ndarray:
        solver = self._solver(added)
        return pair_resistances(self.conducting, solver, self.nodes[u], self.nodes[v], width, seed)

    def incidences(self, u: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
        rhs, at = np.zeros((self.n, len(u))), np.arange(len(u))
        rhs[self.nodes[u], at], rhs[self.nodes[v], at] = 1.0, -1.0
        return list(self._solver(NONE).solve(rhs)[self.nodes].T)


def systems_at(edges: DataFrame, coordinates: DataFrame, nodes: np.ndarray, n: int, eta: float, rtol: float = 1e-7) -> HeldSystems | WorkerSystems:
    """The graph's systems, wanted at ``nodes``: factored, by workers up to WORKER_EDGES edges, or with vectors on the driver."""
    if n > DENSE and edges.limit(WORKER_EDGES + 1).count() <= WORKER_EDGES:
        return WorkerSystems(edges, coordinates, nodes, n, eta, rtol)
    return HeldSystems(edges, coordinates, nodes, n, eta, rtol)


def greedy_order(edges: DataFrame, coordinates: DataFrame, candidates: DataFrame, budget: int, n: int, eta: float = 0.1, alpha: float = ANTAGONISTIC_WEIGHT, rtol: float = 1e-7) -> DataFrame:
    """The chosen candidates with ``selection_step`` from 1: each step takes the edge that lowers the energy most.

    After a choice one solve, corrected by all earlier choices, updates resistances and potentials, all of them at
    the nodes of the candidates only. Workers solve for the best candidates before they are chosen. Equal gains
    go to the earlier candidate. The antagonistic signal stays as it is, only positive edges being added.
    """
    check_candidates(candidates, n)
    pool = candidates.orderBy("sample_rank" if "sample_rank" in candidates.columns else "source").toPandas()
    nodes, at = np.unique(np.concatenate([pool["source"], pool["target"]]), return_inverse=True)
    u, v = at[: len(pool)], at[len(pool) :]
    systems = systems_at(edges, coordinates, nodes, n, eta, rtol)
    ((hz, hy, _, _),) = systems.potentials([NONE])
    resistance = systems.resistances(u, v, NONE, SKETCH, SKETCH_SEED)
    free = np.ones(len(u), bool)
    earlier: list[tuple[np.ndarray, int, int, float]] = []
    chosen, solved = [], {}
    for step in range(total := min(budget, len(u))):
        gains = np.where(free, edge_gains(hz, hy, resistance, u, v, alpha), -np.inf)
        best = int(gains.argmax())
        a, b = int(u[best]), int(v[best])
        if best not in solved:
            order = [int(i) for i in np.argsort(-gains, kind="stable") if free[i] and int(i) not in solved]
            more = order[: systems.ahead(total - step)]
            solved.update(zip(more, systems.incidences(u[more], v[more])))
        own = solved.pop(best)[:, None]
        for w, s, t, den in earlier:
            own = rank_one_update(own, w, s, t, den)
        own = own[:, 0]
        den = 1.0 + own[a] - own[b]
        hz, hy = rank_one_update(hz, own, a, b, den), rank_one_update(hy, own, a, b, den)
        resistance = np.maximum(resistance - (own[u] - own[v]) ** 2 / den, 1e-12)
        earlier.append((own, a, b, den))
        free[best] = False
        chosen.append(best)
    systems.close()
    out = pool.iloc[chosen].reset_index(drop=True)
    out.insert(0, "selection_step", np.arange(1, len(out) + 1))
    return edges.sparkSession.createDataFrame(out)


def initial_prefilter(edges: DataFrame, coordinates: DataFrame, candidates: DataFrame, budget: int, cap: int, n: int, eta: float = 0.1, alpha: float = ANTAGONISTIC_WEIGHT) -> DataFrame:
    """The ``cap`` candidates of greatest first gain, for large pools; a pool within the cap stays as it is.

    Equal gains go to the earlier candidate. Gains are worked out where the candidates are, only the vectors of
    the nodes are sent there; the driver never holds the pool.
    """
    if cap < budget:
        raise ValueError("the cap must not be below the budget")
    if candidates.limit(cap + 1).count() <= cap:
        return candidates
    conducting = weighted_edges(edges, 1.0, eta)
    solver = Solver(conducting, n, grounded=True)
    z, y = held_values(coordinates, n), held_values(antagonistic_signal(edges, coordinates), n)
    held = (solver.solve(z - z.mean(0)), solver.solve(y - y.mean(0)), resistance_sketch(conducting, solver))
    sent = edges.sparkSession.sparkContext.broadcast(held)  # at most three blocks of HELD numbers

    @F.pandas_udf("double")
    def gain(source: pd.Series, target: pd.Series) -> pd.Series:
        hz, hy, sketch = sent.value
        u, v = source.to_numpy(), target.to_numpy()
        return pd.Series(edge_gains(hz, hy, np.maximum(((sketch[u] - sketch[v]) ** 2).sum(1), 1e-12), u, v, alpha))

    tie = "sample_rank" if "sample_rank" in candidates.columns else "source"
    ranked = candidates.withColumn("__gain", gain("source", "target")).orderBy(F.desc("__gain"), tie, "source", "target")
    return ranked.limit(cap).drop("__gain")


def batch_select(order: np.ndarray, available: np.ndarray, codes: np.ndarray, counts: np.ndarray, take: int, equal: bool, done: int, pairs: int, keys: np.ndarray) -> list[int]:
    """The next ``take`` of an order: free, of no edge already taken, and in equal mode within each pair's quota."""
    picked: list[int] = []
    seen: set = set()
    for i in order:
        if len(picked) == take:
            break
        if not available[i] or keys[i] in seen:
            continue
        if equal and counts[codes[i]] >= math.ceil((done + len(picked) + 1) / pairs):
            continue
        picked.append(int(i))
        seen.add(keys[i])
        counts[codes[i]] += 1
    return picked


def batched_greedy(edges: DataFrame, coordinates: DataFrame, candidates: DataFrame, budget: int, batch: int, n: int, equal: bool = False, eta: float = 0.1, alpha: float = ANTAGONISTIC_WEIGHT) -> DataFrame:
    """Like ``greedy_order``, everything being computed anew after each batch; the form for large budgets."""
    check_candidates(candidates, n)
    pool = candidates.orderBy("sample_rank" if "sample_rank" in candidates.columns else "source").toPandas()
    u, v = pool["source"].to_numpy(), pool["target"].to_numpy()
    labels = list(zip(pool["community_1"], pool["community_2"])) if "community_1" in pool else [(0, 0)] * len(pool)
    names = {c: i for i, c in enumerate(sorted(set(labels)))}
    codes, counts = np.array([names[c] for c in labels]), np.zeros(len(names), int)
    keys = u.astype(np.int64) * n + v
    available = np.ones(len(u), bool)
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    pu, pv = at[: len(u)], at[len(u) :]
    systems, chosen = systems_at(edges, coordinates, nodes, n, eta), []
    while len(chosen) < min(budget, len(u)):
        added = np.stack([u[chosen], v[chosen]])
        ((hz, hy, _, _),) = systems.potentials([added])
        resistance = systems.resistances(pu, pv, added, SKETCH, SKETCH_SEED)
        order = np.argsort(-edge_gains(hz, hy, resistance, pu, pv, alpha), kind="stable")
        picked = batch_select(order, available, codes, counts, min(batch, budget - len(chosen)), equal, len(chosen), len(names), keys)
        if not picked:
            break
        chosen += picked
        available[np.isin(keys, keys[picked])] = False
    systems.close()
    out = pool.iloc[chosen].reset_index(drop=True)
    out.insert(0, "selection_step", np.arange(1, len(out) + 1))
    return edges.sparkSession.createDataFrame(out)


def prefix_energies(edges: DataFrame, coordinates: DataFrame, selected: DataFrame, checkpoints: list[int], n: int, eta: float = 0.1, alpha: float = ANTAGONISTIC_WEIGHT) -> DataFrame:
    """``budget, energy, polarization, reduction_pct`` with exactly the first so many chosen edges added, and for 0."""
    chosen = selected.select("selection_step", "source", "target").toPandas()
    budgets = [0, *checkpoints]
    prefixes = [chosen.loc[chosen["selection_step"] <= b, ["source", "target"]].to_numpy(np.int64).T for b in budgets]
    systems = systems_at(edges, coordinates, np.zeros(0, np.int64), n, eta)
    rows = [(b, structural + alpha * antagonistic) for b, (_, _, structural, antagonistic) in zip(budgets, systems.potentials(prefixes))]
    systems.close()
    first = rows[0][1]
    reduction = lambda e: 100.0 * (1.0 - math.sqrt(max(e, 0.0) / first))
    return edges.sparkSession.createDataFrame([(b, e, math.sqrt(max(e, 0.0)), reduction(e)) for b, e in rows], "budget int, energy double, polarization double, reduction_pct double")


def budget_plan(n_train: int, rates: list[float], checkpoints: tuple[float, ...] = (0.25, 0.5, 0.75, 1.0)) -> dict:
    """Budgets as fractions of the training edges, the candidate cap, and checkpoints of the largest budget."""
    budgets = [max(1, math.floor(r * n_train)) for r in rates]
    top = max(budgets)
    return {"budgets": budgets, "candidate_cap": 20 * top, "checkpoints": [max(1, math.floor(f * top)) for f in checkpoints]}


# ---------------------------------------------------------------------------------- augmentation
def augment(physical: DataFrame, additions: DataFrame) -> DataFrame:
    """The physical graph with positive unit edges added; a loop, repetition or existing pair raises an error."""
    new = additions.select(pair_low().alias("source"), pair_high().alias("target"))
    base = physical.select(pair_low().alias("source"), pair_high().alias("target"))
    n, distinct, loops = new.agg(F.count(F.lit(1)), F.countDistinct("source", "target"), F.count_if(F.col("source") == F.col("target"))).first()
    if loops:
        raise ValueError("an added edge is a self-loop")
    if distinct != n:
        raise ValueError("duplicate physical edges are added")
    if not new.join(base, ["source", "target"], "left_semi").isEmpty():
        raise ValueError("an added edge exists already")
    return physical.unionByName(new.select("source", "target", F.lit(1).alias("sign"), F.lit(1.0).alias("weight")), allowMissingColumns=True)


def edge_jaccard(one: DataFrame, two: DataFrame) -> DataFrame:
    """One row ``jaccard`` of two edge sets; null if both are empty."""
    a = one.select(pair_low().alias("s"), pair_high().alias("t")).distinct().withColumn("a", F.lit(1))
    b = two.select(pair_low().alias("s"), pair_high().alias("t")).distinct().withColumn("b", F.lit(1))
    return a.join(b, ["s", "t"], "full").agg(F.try_divide(F.sum(F.col("a") * F.col("b")).cast("double"), F.count(F.lit(1)).cast("double")).alias("jaccard"))


def sampled_batch(selected: DataFrame, budget: int) -> DataFrame:
    """The first ``budget`` chosen edges; fewer raise an error."""
    out = selected.where(F.col("selection_step") <= budget)
    if (n := out.count()) < budget:
        raise ValueError(f"only {n} of {budget} edges are chosen")
    return out


def random_baseline(physical: DataFrame, num_nodes: int, budget: int, seed: int = 0, strict: bool = True) -> DataFrame:
    """The graph with as many random edges added as the budget says, without ``strict`` at most as many as are free."""
    return augment(physical, non_edges(num_nodes, physical, budget, f"{seed}|2026|{budget}", strict=strict))


def global_baseline(edges: DataFrame, coordinates: DataFrame, num_nodes: int, cap: int, budget: int, seed: int = 0) -> DataFrame:
    """Greedy choice among random non-edges of the whole graph."""
    pool = non_edges(num_nodes, edges, cap, f"{seed}|2026|{cap}")
    return greedy_order(edges, coordinates, pool, budget, num_nodes)
