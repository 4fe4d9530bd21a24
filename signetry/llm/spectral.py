"""Clusters of mutually similar nodes by power-iteration spectral clustering over a sparse affinity graph.

Both vectors of a node are brought to unit length and joined to one. Random-hyperplane signatures put similar
nodes into common cells; every node of a cell is linked to the first node of the cell only, so a cell of any size
gives links in proportion to its nodes. This is done with arrays in the leaves of a tree over the shorter vectors. Nodes without a smaller similar node are then compared with each other
exactly, however many there are: the leaves of a tree over their shorter vectors meet as far as these can be similar. Links are verified, their weight is the smaller cosine; shortcuts along smaller and
smaller nodes bring the nodes of a group near to each other in the graph. Components of the graph are dealt to
workers, which take many whole ones at once; the largest ones go through joins. Several vectors start at the nodes without a smaller one and are iterated with the normalised affinities.
k-means over the embedding makes the clusters: seeds are the occupied cells of a grid over the embedding, centres
and points meet through shifted grids, never all with all. Members are ranked by their affinity to the rest.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import component_labels
from ..session import discard, stored

COSINE = 0.85
SMALLEST = 5
FIRST_TABLES, TABLES = 8, 32
BLOCK, PAIR_BLOCK = 131_072, 4_096
LEAF = 65_536  # nodes whose first links one task finds
LEAVES, LEAST = 8, 4_096  # leaves that even few nodes are spread over, if these have so many nodes each
TILE = 1_024  # nodes compared at once
MANY = 2e-3  # share of their pairs from which on a product of matrices is faster than one pair after the other
MISSED = 1e-3  # share of pairs at the limit that share no cell, where a caller allows that
CARRIED = 300_000  # links of about as many whole components, or vectors, are a worker's share
HEAVY = 3_000_000  # links of a component from which on joins take over
JUMPS = 3  # doublings of the way a shortcut goes
VECTORS = 4
STEPS = 12
SLOWEST = 0.75  # eigenvalues of the walk up to this one are damped evenly; within groups they are below it
NEAR = 1e-4  # points of the embedding nearer than this in every place are one seed
ROUNDS = 2
TYPICAL = 3


def _unit(v: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors without null or infinite values and not all zero, scaled to unit length, and their places in ``v``."""
    flat = pc.list_flatten(v).cast(pa.float64())
    x = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).reshape(len(v), width)
    largest = np.abs(x).max(1) if len(x) else np.zeros(0)
    fine = np.flatnonzero(np.isfinite(largest) & (largest > 0))
    x = x[fine] / largest[fine][:, None]
    return x / np.sqrt((x * x).sum(1))[:, None], fine


def _usable(rows: DataFrame, column: str, width: int) -> DataFrame:
    """The rows that may have a usable vector: with a node and the full width."""
    return rows.where(F.col("node_id").isNotNull() & (F.size(column) == width)).select("node_id", F.col(column))


def _greatest(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each id once, in order, with the greatest of its vectors."""
    order = np.argsort(ids, kind="stable")
    own = ids[order]
    if not (several := own[1:] == own[:-1]).any():
        return own, x[order]
    last = np.append(~several, True)
    single = last & np.insert(~several, 0, True)
    rest = order[~single]
    rest = rest[np.lexsort((*x[rest].T[::-1], ids[rest]))]
    kept = np.concatenate([order[single], rest[np.append(ids[rest][1:] != ids[rest][:-1], True)]])
    kept = kept[np.argsort(ids[kept])]
    return ids[kept], x[kept]


def unit_vectors(embeddings: DataFrame, opinions: DataFrame, widths: tuple[int, int] = (64, 8)) -> DataFrame:
    """``node_id, z`` of the nodes with both usable vectors: the two unit vectors one after the other.

    A vector is usable if it has the full width, no null, NaN or infinite value, and is not all zero. Of several
    different ones of a node the greatest counts. The rows of both tables meet by their node in one partition,
    where equal ids are taken together as they arrive, so that a node with many rows takes no room.
    """

    def meet(batches):
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        waiting = [0, 0]
        for batch in batches:
            for k, width in enumerate(widths):
                rows = batch.filter(pc.is_valid(batch.column(k + 1)))
                x, fine = _unit(rows.column(k + 1), width)
                held[k].append((rows.column(0).to_numpy()[fine], x))
                waiting[k] += len(x)
                if waiting[k] > BLOCK:
                    held[k], waiting[k] = [_greatest(*map(np.concatenate, zip(*held[k])))], 0
        if not all(held):
            return
        (one, x), (two, y) = (_greatest(*map(np.concatenate, zip(*h))) for h in held)
        ids, at, to = np.intersect1d(one, two, assume_unique=True, return_indices=True)
        for k in range(0, len(ids), PAIR_BLOCK):
            z = np.hstack([x[at[k : k + PAIR_BLOCK]], y[to[k : k + PAIR_BLOCK]]]).astype(np.float32)
            yield pa.record_batch({"node_id": ids[k : k + PAIR_BLOCK], "z": _lists(z)})

    none = [F.lit(None).cast(df.schema[c].dataType).alias(c) for df, c in ((embeddings, "node_embeddings"), (opinions, "opinion_coordinates"))]
    a = _usable(embeddings, "node_embeddings", widths[0]).select("node_id", "node_embeddings", none[1])
    b = _usable(opinions, "opinion_coordinates", widths[1]).select("node_id", none[0], "opinion_coordinates")
    both = a.unionByName(b).select(F.col("node_id").cast("bigint"), "node_embeddings", "opinion_coordinates")
    parts = max(3 * both.sparkSession.sparkContext.defaultParallelism, math.ceil((embeddings.count() + opinions.count()) / BLOCK))
    return both.repartition(parts, "node_id").mapInArrow(meet, "node_id bigint, z array<float>")


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1)))


def _matrix(z: pa.Array, width: int) -> np.ndarray:
    return z.flatten().to_numpy(zero_copy_only=False).reshape(len(z), width)


def _signs(z: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """One signature per row and table: the sides of ``bits`` random hyperplanes."""
    planes = np.random.default_rng(seed).standard_normal((z.shape[1], tables * bits)).astype(np.float32)
    side = (z @ planes > 0).reshape(len(z), tables, bits)
    out = np.zeros((len(z), tables), np.int64)
    for k in range(bits):
        out |= side[:, :, k].astype(np.int64) << k
    return out


def signatures(z: Column, bits: int, tables: int, width: int, seed: int = 7) -> Column:
    """The signatures of the vectors of a column."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def sign(z: pa.Array) -> pa.Array:
        return _lists(_signs(_matrix(z, width), bits, tables, seed))

    return sign(z)


def _cosines(split: int, width: int):
    """Smaller of the two cosines of two nodes, in both of which the unit vectors follow each other."""

    @F.arrow_udf(T.DoubleType())
    def least(x: pa.Array, y: pa.Array) -> pa.Array:
        p = _matrix(x, width).astype(np.float64) * _matrix(y, width)
        return pa.array(np.minimum(p[:, :split].sum(1), p[:, split:].sum(1)))

    return least


def _cell_links(nodes: DataFrame, bits: int, tables: int, widths: tuple[int, int], cosine: float, seed: int, ends: tuple[str, ...]) -> DataFrame:
    """Verified links of nodes to the first (and last) node of each of their cells, each pair once."""
    width = sum(widths)
    cells = nodes.select("node_id", F.posexplode(signatures(F.col("z"), bits, tables, width, seed)).alias("at", "sign"))
    leaders = cells.groupBy("at", "sign").agg(F.min("node_id").alias("low"), F.max("node_id").alias("high")).where("low <> high")
    linked = cells.join(leaders, ["at", "sign"]).select("node_id", F.explode(F.array(*ends)).alias("leader"))
    pairs = linked.where("node_id <> leader").select(F.least("node_id", "leader").alias("source"), F.greatest("node_id", "leader").alias("target")).distinct()
    one = nodes.select(F.col("node_id").alias("source"), F.col("z").alias("zs"))
    two = nodes.select(F.col("node_id").alias("target"), F.col("z").alias("zt"))
    least = _cosines(widths[0], width)
    out = pairs.join(one, "source").join(two, "target").select("source", "target", least("zs", "zt").alias("weight"))
    return out.where(F.col("weight") >= cosine)


def affinity_links(nodes: DataFrame, widths: tuple[int, int] = (64, 8), cosine: float = COSINE, exact: int | None = None) -> DataFrame:
    """``source, target, weight, component`` with ``source < target``: verified links between similar nodes, each pair once.

    A few tables link nodes to the first node of each of their cells. Whoever has a smaller similar node then is
    reached through it; the others are compared with each other, whatever their number, so that every two members
    of a whole group are joined by links. A caller may set ``exact``: more of them than that go through as many
    tables as keep the recall of a pair at the limit at 1 - MISSED for any number of bits.
    """
    n = nodes.count()
    bits = min(60, max(10, math.ceil(math.log2(n + 1)) + 6))
    first = stored(_leaf_links(nodes, n, bits, widths, cosine))
    links = first.where("z is null").select("source", "target", "weight", "root")
    heads = first.where("z is not null").select(F.col("source").alias("node_id"), "z", "root")
    n_heads = heads.count()
    if exact is None or n_heads <= exact:
        found = _block_links(heads.drop("root"), n_heads, widths, cosine)
    else:
        same = (1 - math.acos(cosine) / math.pi) ** bits
        tables = range(math.ceil(math.log(MISSED) / math.log1p(-same) / TABLES))
        found = reduce(DataFrame.unionByName, [stored(_cell_links(heads.drop("root"), bits, TABLES, widths, cosine, 9 + k, ("low", "high"))) for k in tables])
        found = found.groupBy("source", "target").agg(F.max("weight").alias("weight"))
    return _with_components(links, stored(found), heads.select("node_id", "root"))


def _with_components(links: DataFrame, found: DataFrame, roots: DataFrame) -> DataFrame:
    """Both kinds of links with the ``component`` that they belong to, named by one of its nodes.

    Links found in leaves have the smallest node of their part of a component; what joins parts is known from
    the links of ``roots``, so only these are labelled.
    """
    ends = [roots.select(F.col("node_id").alias(end), F.col("root").alias(f"of_{end}")) for end in ("source", "target")]
    joined = stored(found.join(ends[0], "source").join(ends[1], "target"))
    labels = component_labels(joined.select(F.col("of_source").alias("source"), F.col("of_target").alias("target"))).withColumnRenamed("node_id", "root")
    every = links.unionByName(joined.select("source", "target", "weight", F.col("of_source").alias("root")))
    return every.join(labels, "root", "left").select("source", "target", "weight", F.coalesce("component", "root").alias("component"))


def _least_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place that each of ``n`` places reaches over the edges between ``a`` and ``b``."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        following = label.copy()
        for ends in (label[a], label[b], a, b):
            np.minimum.at(following, ends, least)
        following = following[following]
        if (following == label).all():
            return label
        label = following


def _leaf_links(nodes: DataFrame, n: int, bits: int, widths: tuple[int, int], cosine: float) -> DataFrame:
    """Verified links of nodes to the first node of each of their cells, as far as that is in the same leaf of a tree.

    ``source, target, weight, root`` of the links, ``root`` being the smallest node reached, and ``source, z, root``
    of the nodes without a smaller similar one. A leaf is worked through by one task with arrays; few nodes are one leaf.
    """
    width, split = sum(widths), widths[0]
    narrow = slice(0, split) if widths[0] <= widths[1] else slice(split, width)
    depth = max(math.ceil(math.log2(max(n, 1) / LEAF)), 0)
    low, high = _borders(nodes, n, depth, narrow, width)
    placed = nodes.withColumn("leaf", _leaf(low, high, narrow, width)(F.col("z"))) if depth else nodes.withColumn("leaf", F.lit(0))
    sizes = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()} if depth else {}
    parts = F.array(*[F.lit(max(1, math.ceil(sizes.get(k, 0) / (2 * LEAF)))) for k in range(len(low))])
    placed = placed.withColumn("part", F.pmod(F.xxhash64("node_id"), parts[F.col("leaf")]))

    def link(rows: pa.Table) -> pa.Table:
        ids = rows["node_id"].to_numpy()
        order = np.argsort(ids)
        ids, z = ids[order], _matrix(rows["z"].combine_chunks(), width)[order]
        signs = np.concatenate([_signs(z[k : k + PAIR_BLOCK], bits, FIRST_TABLES, 7) for k in range(0, len(z), PAIR_BLOCK)])
        pairs = []
        for k in range(FIRST_TABLES):
            by = np.argsort(signs[:, k], kind="stable")
            starts = np.flatnonzero(np.insert(signs[by[1:], k] != signs[by[:-1], k], 0, True))
            leader = np.repeat(by[starts], np.diff(np.append(starts, len(by))))
            pairs.append((leader * len(ids) + by)[leader != by])
        a, b = np.divmod(np.unique(np.concatenate(pairs)), len(ids))
        weight = np.zeros(len(a))
        for k in range(0, len(a), BLOCK // 8):
            p = z[a[k : k + BLOCK // 8]].astype(np.float64) * z[b[k : k + BLOCK // 8]]
            weight[k : k + BLOCK // 8] = np.minimum(p[:, :split].sum(1), p[:, split:].sum(1))
        fine = weight >= cosine
        a, b, weight = a[fine], b[fine], weight[fine]
        root = ids[_least_reached(len(ids), a, b)]
        heads = np.ones(len(ids), bool)
        heads[b] = False
        lengths = np.concatenate([np.zeros(len(a), np.int32), np.full(heads.sum(), width, np.int32)])
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
        shown = pa.ListArray.from_arrays(offsets, pa.array(z[heads].reshape(-1)), mask=pa.array(lengths == 0))
        none = np.zeros(heads.sum(), np.int64)
        return pa.table({
            "source": np.concatenate([ids[a], ids[heads]]), "target": np.concatenate([ids[b], none]),
            "weight": np.concatenate([weight, none]), "root": np.concatenate([root[a], root[heads]]), "z": shown,
        })

    return placed.groupBy("leaf", "part").applyInArrow(link, "source bigint, target bigint, weight double, root bigint, z array<float>")


def _borders(nodes: DataFrame, n: int, depth: int, narrow: slice, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Borders of the leaves of a tree cut by some of the nodes, which decides on the size of the leaves alone."""
    some = nodes.where(F.pmod(F.xxhash64("node_id", F.lit(1)), F.lit(max(1, n // max(20_000, 64 << depth)))) == 0)
    rows = some.select("z").toArrow()["z"].combine_chunks() if depth else pa.array([], pa.list_(pa.float32()))
    return tuple(np.stack(side) for side in zip(*_tree(_matrix(rows, width)[:, narrow], depth)))


def _leaf(low: np.ndarray, high: np.ndarray, narrow: slice, width: int):
    """Number of the leaf that a vector stands in."""

    @F.arrow_udf(T.IntegerType())
    def leaf(z: pa.Array) -> pa.Array:
        x = _matrix(z, width)[:, narrow]
        at = np.zeros(len(x), np.int32)
        for k in range(len(low)):
            at[((x >= low[k]) & (x < high[k])).all(1)] = k
        return pa.array(at)

    return leaf


def _tree(points: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Borders ``(low, high)`` of 2 ** ``depth`` boxes that fill the space, each cut at the median of its widest place."""
    width = points.shape[1]

    def cut(own: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> list:
        if not depth:
            return [(low, high)]
        place = int((own.max(0) - own.min(0)).argmax()) if len(own) else 0
        at = np.float32(np.median(own[:, place])) if len(own) else min(max(np.float32(0), low[place]), high[place])
        left, right = high.copy(), low.copy()
        left[place] = right[place] = at
        beyond = own[:, place] >= at
        return cut(own[~beyond], low, left, depth - 1) + cut(own[beyond], right, high, depth - 1)

    return cut(points, np.full(width, -np.inf, np.float32), np.full(width, np.inf, np.float32), depth)


def _tiles(x: np.ndarray) -> tuple[np.ndarray, list[slice]]:
    """An order of the rows by halves of their widest places, and slices of it of at most TILE rows."""

    def halved(own: np.ndarray) -> list[np.ndarray]:
        if len(own) <= TILE:
            return [own]
        part = x[own]
        own = own[np.argpartition(part[:, int((part.max(0) - part.min(0)).argmax())], len(own) // 2)]
        return halved(own[: len(own) // 2]) + halved(own[len(own) // 2 :])

    parts = halved(np.arange(len(x))) if len(x) else []
    ends = np.cumsum([0, *map(len, parts)])
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), [slice(*e) for e in zip(ends, ends[1:])]


def _block_links(nodes: DataFrame, n: int, widths: tuple[int, int], cosine: float) -> DataFrame:
    """Verified links among all pairs of nodes.

    Similar nodes are no further apart in the narrower vector than a chord. Nodes stand in the leaf of a tree over
    that vector, and go to all leaves within the chord; within two leaves tiles within the chord are compared. The
    tree is cut by some of the nodes, which decides on the size of the leaves alone; larger ones are split by hash.
    """
    width, split = sum(widths), widths[0]
    narrow, wider = (slice(0, split), slice(split, width))[:: 1 if widths[0] <= widths[1] else -1]
    chord = 2 - 2 * (cosine - 1e-3)  # its square, with room for rounding
    depth = max(math.ceil(math.log2(max(n, 1) / BLOCK)), min(round(math.log2(LEAVES)), math.floor(math.log2(max(n, 1) / LEAST))), 0)
    low, high = _borders(nodes, n, depth, narrow, width)
    placed = nodes.withColumn("leaf", _leaf(low, high, narrow, width)(F.col("z")))
    sizes = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [max(1, math.ceil(sizes.get(k, 0) / BLOCK)) for k in range(len(low))]
    first = np.cumsum([0, *parts])

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def reached(z: pa.Array) -> pa.Array:
        x = _matrix(z, width)[:, narrow]
        near = np.stack([(np.maximum(np.maximum(low[k] - x, x - high[k]), 0) ** 2).sum(1) <= chord for k in range(len(low))], 1)
        near = np.repeat(near, parts, axis=1)
        ends = np.concatenate([[0], np.cumsum(near.sum(1))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(near)[1].astype(np.int32)))

    def similar(rows: pa.Table) -> pa.Table:
        z = _matrix(rows["z"].combine_chunks(), width)
        ids, block = rows["node_id"].to_numpy(), rows["block"].to_numpy()
        same = rows["low"][0].as_py() == rows["high"][0].as_py()
        sides = []
        for own in (rows["low"][0].as_py(), rows["high"][0].as_py())[: 1 if same else 2]:
            at = np.flatnonzero(block == own)
            order, tiles = _tiles(z[at, narrow])
            at = at[order]
            x = np.ascontiguousarray(z[at, narrow])
            sides.append((at, x, tiles, np.array([x[t].min(0) for t in tiles]), np.array([x[t].max(0) for t in tiles])))
        (one, x, tiles, least, most), (two, y, others, lows, highs) = sides[0], sides[-1]
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for k, t in enumerate(tiles):
            if not others:
                break
            apart = (np.maximum(np.maximum(lows - most[k], least[k] - highs), 0) ** 2).sum(1)
            for j in np.flatnonzero(apart <= chord):
                if same and j < k:
                    continue
                near = x[t] @ y[others[j]].T >= cosine - 1e-4  # the narrower vector rules most out
                if np.count_nonzero(near) > MANY * near.size:
                    near &= z[one[t], wider] @ z[two[others[j]], wider].T >= cosine - 1e-4
                a, b = np.divmod(np.flatnonzero(near), others[j].stop - others[j].start)
                if same and j == k:
                    a, b = a[a < b], b[a < b]
                for at in range(0, len(a), 65_536):
                    c, d = one[t][a[at : at + 65_536]], two[others[j]][b[at : at + 65_536]]
                    p = z[c].astype(np.float64) * z[d]
                    weight = np.minimum(p[:, :split].sum(1), p[:, split:].sum(1))
                    fine = weight >= cosine
                    s, e = ids[c[fine]], ids[d[fine]]
                    out.append((np.minimum(s, e), np.maximum(s, e), weight[fine]))
        return pa.table(dict(zip(("source", "target", "weight"), map(np.concatenate, zip(*out)))))

    starts, several = F.array(*map(F.lit, first.tolist())), F.array(*map(F.lit, parts))
    block = (starts[F.col("leaf")] + F.pmod(F.xxhash64("node_id"), several[F.col("leaf")])).cast("int")
    met = placed.withColumn("block", block).withColumn("k", F.explode(reached("z")))
    pairs = met.select("node_id", "z", "block", F.least("block", "k").alias("low"), F.greatest("block", "k").alias("high"))
    return pairs.groupBy("low", "high").applyInArrow(similar, "source bigint, target bigint, weight double")


def shortcuts(links: DataFrame, jumps: int = JUMPS) -> DataFrame:
    """``node_id, up, weight``: per node the smallest node reached along smallest neighbours, up to 2 ** ``jumps`` of them.

    The weight is the product of the weights on the way.
    """
    near = links.groupBy(F.col("target").alias("node_id")).agg(F.min(F.struct("source", "weight")).alias("x"))
    near = stored(near.select("node_id", F.col("x.source").alias("up"), F.col("x.weight").alias("weight")))
    for _ in range(jumps):
        over = near.select(F.col("node_id").alias("up"), F.col("up").alias("further"), F.col("weight").alias("then"))
        ahead = near.join(over, "up", "left").select("node_id", F.coalesce("further", "up").alias("up"), (F.col("weight") * F.coalesce("then", F.lit(1.0))).alias("weight"))
        following = stored(ahead)
        discard(near)
        near = following
    return near


def _damping(steps: int, slowest: float = SLOWEST) -> list[tuple[float, float]]:
    """``(a, b)`` of each step: next = a * (2 / slowest * walked - now) + b * before, by Chebyshev's recurrence.

    The value that stays within a group keeps its size, the parts with eigenvalues up to ``slowest`` shrink as
    fast as any polynomial of this degree can make them.
    """
    top = 2 / slowest - 1
    before, now, out = 1.0, top, [(1 / top, 0.0)]
    for _ in range(steps - 1):
        following = 2 * top * now - before
        out.append((2 * now / following, -before / following))
        before, now = now, following
    return out[:steps]


def spectral_embedding(links: DataFrame, vectors: int = VECTORS, steps: int = STEPS) -> DataFrame:
    """``node_id, x0, x1, ...`` after ``steps`` rounds of the lazy random walk over links and shortcuts.

    A shortcut weighs as much as all links of its node. Dividing by the degree normalises the affinities; half of
    each value stays where it is, which keeps all eigenvalues positive. The vectors start with a hash of the id at
    nodes without a smaller similar one and with 0 elsewhere, so their size does not fall with that of a group.
    """
    short = shortcuts(links)
    one_way = links.select(F.col("source").alias("a"), F.col("target").alias("b"), "weight")
    own = one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")).groupBy(F.col("a").alias("node_id")).agg(F.sum("weight").alias("own"))
    heavy = short.join(own, "node_id").select(F.col("up").alias("a"), F.col("node_id").alias("b"), (F.col("weight") * F.col("own")).alias("weight"))
    edges = one_way.unionByName(heavy).groupBy("a", "b").agg(F.sum("weight").alias("weight"))
    both = stored(edges.select(F.col("a").alias("source"), F.col("b").alias("target"), "weight").unionByName(edges.select(F.col("b").alias("source"), F.col("a").alias("target"), "weight")))
    degree = both.groupBy(F.col("source").alias("node_id")).agg(F.sum("weight").alias("degree"), F.min("target").alias("least"))
    start = [F.when(F.col("node_id") < F.col("least"), F.pmod(F.xxhash64("node_id", F.lit(k)), F.lit(1 << 20)) / float(1 << 19) - 1).otherwise(0.0) for k in range(vectors)]
    names = [f"x{k}" for k in range(vectors)]
    state = stored(degree.select("node_id", "degree", *[v.alias(x) for v, x in zip(start, names)], *[F.lit(0.0).alias(f"b{x}") for x in names]))
    for a, b in _damping(steps):
        sent = both.join(state.select(F.col("node_id").alias("target"), *names), "target")
        got = sent.groupBy(F.col("source").alias("node_id")).agg(*[F.sum(F.col("weight") * F.col(x)).alias(f"y{x}") for x in names])
        walked = {x: 0.5 * F.col(x) + 0.5 * F.col(f"y{x}") / F.col("degree") for x in names}
        moved = [(a * (2 / SLOWEST * walked[x] - F.col(x)) + b * F.col(f"b{x}")).alias(x) for x in names]
        following = stored(state.join(got, "node_id").select("node_id", "degree", *moved, *[F.col(x).alias(f"b{x}") for x in names]))
        discard(state)
        state = following
    return state.select("node_id", *names)


def _grid(names: list[str], cell: float, shift: float = 0.0) -> Column:
    """Number of the cell of a grid over the embedding that a point lies in."""
    return F.xxhash64(*[F.floor((F.col(x) + F.lit(shift)) / F.lit(cell)) for x in names], F.lit(round(shift / cell, 6)))


def _meeting(points: DataFrame, names: list[str], near: float) -> DataFrame:
    """``points`` once for each of several shifted grids, in ``cell``.

    Between two points nearer than ``near`` in every place each place has a border in one of the grids at most.
    With one grid more than places some grid has both in one cell.
    """
    grids = len(names) + 1
    return points.withColumn("cell", F.explode(F.array(*[_grid(names, grids * near, k * near) for k in range(grids)])))


def embedding_kmeans(state: DataFrame, vectors: int = VECTORS, rounds: int = ROUNDS, near: float = NEAR) -> DataFrame:
    """``node_id, centre``: k-means over the embedding, its number of clusters following from the data.

    Equal points, to a twentieth of ``near``, are pooled first with their number, so a group of any size is a few
    points. Each pool is a seed unless a smaller one lies within ``near``; then in each round every pool takes the
    nearest centre it meets, the smaller one of equally near, and centres move to the mean of their nodes. A
    centre is named by its smallest node. With no rounds every pool stays a cluster of its own.
    """
    names = [f"x{k}" for k in range(vectors)]
    placed = state.withColumn("pool", _grid(names, near / 20))
    pools = stored(placed.groupBy("pool").agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("centre"), *[F.avg(x).alias(x) for x in names]))
    assigned = pools.select("pool", "centre")
    if rounds:
        points = stored(_meeting(pools, names, near).select("pool", "centre", "cell", *names))
        other = points.select("cell", F.col("centre").alias("smaller"), *[F.col(x).alias(f"o{x}") for x in names])
        close = F.greatest(*[F.abs(F.col(x) - F.col(f"o{x}")) for x in names]) < near
        beside = points.join(other, "cell").where((F.col("smaller") < F.col("centre")) & close).select("pool").distinct()
        centres = stored(pools.join(beside, "pool", "left_anti").select("centre", *names))
        away = sum(((F.col(x) - F.col(f"o{x}")) ** 2 for x in names), F.lit(0.0))
        for _ in range(rounds):
            reach = _meeting(centres, names, near).select("cell", F.col("centre").alias("to"), *[F.col(x).alias(f"o{x}") for x in names])
            best = points.join(reach, "cell").groupBy("pool").agg(F.min(F.struct(away.alias("away"), "to")).alias("best"))
            assigned = stored(best.select("pool", F.col("best.to").alias("centre")))
            moved = pools.drop("centre").join(assigned, "pool").groupBy("centre")
            centres = stored(moved.agg(*[(F.sum(F.col(x) * F.col("n")) / F.sum("n")).alias(x) for x in names]))
    return placed.select("node_id", "pool").join(assigned, "pool").select("node_id", "centre")


_P = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _P[1]
    x = (x ^ (x >> np.uint64(29))) * _P[2]
    return x ^ (x >> np.uint64(32))


def _hashed(ids: np.ndarray, k: int) -> np.ndarray:
    """Spark's ``xxhash64(id, k)`` of a bigint and an int."""
    one = ids.astype(np.int64).view(np.uint64) * _P[1]
    x = np.full(len(ids), 42, np.uint64) + _P[4] + np.uint64(8)
    x = _mixed(_turned(x ^ (_turned(one, 31) * _P[0]), 27) * _P[0] + _P[3])
    x = x + _P[4] + np.uint64(4)
    x = x ^ (np.array([k], np.uint64) * _P[0])
    return _mixed(_turned(x, 23) * _P[1] + _P[2]).view(np.int64)


def _walked(source: np.ndarray, target: np.ndarray, weight: np.ndarray, ids: np.ndarray, vectors: int, steps: int) -> np.ndarray:
    """The embedding of ``spectral_embedding`` over links between places of ``ids``, which are in order."""
    n = len(ids)
    order = np.lexsort((-source, target))  # the smallest neighbour of each comes last
    up, way = np.full(n, -1), np.ones(n)
    up[target[order]], way[target[order]] = source[order], weight[order]
    behind = np.flatnonzero(up >= 0)
    for _ in range(JUMPS):
        over = up[up[behind]]
        on = np.where(over >= 0, over, up[behind])
        then = np.where(over >= 0, way[up[behind]], 1.0)
        up[behind], way[behind] = on, way[behind] * then
    own = np.bincount(source, weight, n) + np.bincount(target, weight, n)
    a, b = np.concatenate([source, up[behind]]), np.concatenate([target, behind])
    w = np.concatenate([weight, way[behind] * own[behind]])
    a, b, w = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
    order = np.argsort(a, kind="stable")
    a, b, w = a[order], b[order], w[order]
    starts = np.searchsorted(a, np.arange(n))
    degree = np.add.reduceat(w, starts)
    first = np.minimum.reduceat(b, starts) > np.arange(n)
    now = np.zeros((n, vectors))
    for k in range(vectors):
        now[first, k] = (_hashed(ids[first], k) & ((1 << 20) - 1)) / float(1 << 19) - 1
    before = np.zeros_like(now)
    share = (w / degree[a])[:, None]
    for x, y in _damping(steps):
        got = np.add.reduceat(share * now[b], starts)
        now, before = x * (2 / SLOWEST * (0.5 * now + 0.5 * got) - now) + y * before, now
    return now


def _cells(x: np.ndarray, own: np.ndarray, cell: float, shift: float) -> np.ndarray:
    """Number of the cell of a grid over the embedding, ``own`` being kept apart."""
    out = _mixed(own.astype(np.uint64) + np.uint64(round(shift / cell * 1e6)) * _P[0])
    for place in np.floor((x + shift) / cell).astype(np.int64).view(np.uint64).T:
        out = _mixed(_turned(out, 27) * _P[0] + (place * _P[1] ^ _P[3]))
    return out


def _meetings(ones: np.ndarray, others: np.ndarray):
    """Places ``(one, other)`` with equal cells, a few at a time, no one twice in the same yield."""
    order = np.argsort(others, kind="stable")
    others = others[order]
    at, ends = np.searchsorted(others, ones), np.searchsorted(others, ones, "right")
    one = np.flatnonzero(at < ends)
    while len(one):
        yield one, order[at[one]]
        at[one] += 1
        one = one[at[one] < ends[one]]


def _clustered(x: np.ndarray, own: np.ndarray, rounds: int, near: float = NEAR) -> np.ndarray:
    """The centre, a place, of each row by ``embedding_kmeans``; only rows with the same ``own`` can share one.

    A pool that meets no centre stays one of its own.
    """
    grids = x.shape[1] + 1
    _, centre, pool, n = np.unique(_cells(x, own, near / 20, 0.0), return_index=True, return_inverse=True, return_counts=True)
    points = np.stack([np.bincount(pool, v) / n for v in x.T], 1)
    own = own[centre]
    if not rounds:
        return centre[pool]
    cells = [_cells(points, own, grids * near, k * near) for k in range(grids)]
    seed = np.ones(len(n), bool)
    for c in cells:
        for one, other in _meetings(c, c):
            beside = (centre[other] < centre[one]) & (np.abs(points[one] - points[other]) < near).all(1)
            seed[one[beside]] = False
    to, middle, of = centre[seed], points[seed], own[seed]
    for _ in range(rounds):
        away, best = np.full(len(n), np.inf), centre.copy()
        for k, c in enumerate(cells):
            for one, other in _meetings(c, _cells(middle, of, grids * near, k * near)):
                d = ((points[one] - middle[other]) ** 2).sum(1)
                nearer = (d < away[one]) | ((d == away[one]) & (to[other] < best[one]))
                away[one[nearer]], best[one[nearer]] = d[nearer], to[other[nearer]]
        to, first, at = np.unique(best, return_index=True, return_inverse=True)
        middle, of = np.stack([np.bincount(at, v * n) / np.bincount(at, n) for v in points.T], 1), own[first]
    return best[pool]


def _worker_clusters(links: DataFrame, n: int, steps: int, rounds: int) -> DataFrame:
    """``node_id, cluster_id, closed``: embedding and k-means of whole components, many of them at once with arrays."""

    def cluster(rows: pa.Table) -> pa.Table:
        source, target, weight, component = (rows[c].to_numpy() for c in ("source", "target", "weight", "component"))
        ids, at = np.unique(np.concatenate([source, target]), return_inverse=True)
        source, target = at[: len(source)], at[len(source) :]
        own = np.zeros(len(ids), np.int64)
        own[source], own[target] = component, component
        centre = _clustered(_walked(source, target, weight, ids, VECTORS, steps), own, rounds)
        _, first, of = np.unique(centre, return_index=True, return_inverse=True)  # ids are in order
        closed = np.ones(len(first), bool)
        across = of[source] != of[target]
        closed[of[source[across]]] = closed[of[target[across]]] = False
        return pa.table({"node_id": ids, "cluster_id": ids[first][of], "closed": closed[of]})

    shares = max(links.sparkSession.sparkContext.defaultParallelism, math.ceil(n / CARRIED))
    dealt = links.withColumn("share", F.pmod(F.xxhash64("component"), F.lit(shares)))
    return dealt.groupBy("share").applyInArrow(cluster, "node_id bigint, cluster_id bigint, closed boolean")


def _joined_clusters(links: DataFrame, steps: int, rounds: int) -> DataFrame:
    """``node_id, cluster_id, closed`` of components of any size, by joins."""
    assigned = stored(embedding_kmeans(spectral_embedding(links, steps=steps), rounds=rounds))
    first = assigned.groupBy("centre").agg(F.min("node_id").alias("cluster_id"))
    members = assigned.join(first, "centre").select("node_id", "cluster_id")
    one, two = (members.select(F.col("node_id").alias(end), F.col("cluster_id").alias(f"of_{end}")) for end in ("source", "target"))
    across = links.join(one, "source").join(two, "target").where("of_source <> of_target")
    torn = across.select(F.explode(F.array("of_source", "of_target")).alias("cluster_id")).distinct().withColumn("torn", F.lit(True))
    return members.join(torn, "cluster_id", "left").select("node_id", "cluster_id", F.col("torn").isNull().alias("closed"))


def spectral_clusters(nodes: DataFrame, widths: tuple[int, int] = (64, 8), cosine: float = COSINE, exact: int | None = None, steps: int = STEPS, rounds: int = ROUNDS) -> DataFrame:
    """``node_id, cluster_id, closed, z`` of every node that is similar to another; ``cluster_id`` is the smallest member.

    ``closed`` is false for clusters with a verified link to a node outside. ``nodes`` has ``node_id, z``. No
    similar nodes, or no nodes, give no rows. Components of more than HEAVY links go through joins, all others
    through workers with arrays, which move them the same way.
    """
    links = stored(affinity_links(nodes, widths, cosine, exact))
    n = links.count()
    heavy = links.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HEAVY).select("component") if n > HEAVY else None
    if heavy is None or heavy.isEmpty():
        clusters = _worker_clusters(links, n, steps, rounds)
    else:
        heavy = stored(heavy)
        large = stored(links.join(heavy, "component", "left_semi").drop("component"))
        clusters = _worker_clusters(links.join(heavy, "component", "left_anti"), n, steps, rounds).unionByName(_joined_clusters(large, steps, rounds))
    return stored(clusters.join(nodes, "node_id").select("node_id", "cluster_id", "closed", "z"))


def _centred(clusters: DataFrame, widths: tuple[int, int]) -> DataFrame:
    """Members with the size of their cluster and the sum of its vectors, added up natively in fixed-size states."""
    sums = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), *[F.sum(F.col("z")[i].cast("double")).alias(f"s{i}") for i in range(sum(widths))])
    total = sums.select("cluster_id", "size", F.array(*[F.col(f"s{i}").cast("float") for i in range(sum(widths))]).alias("total"))
    return clusters.join(total, "cluster_id")


def mutual_groups(clusters: DataFrame, widths: tuple[int, int] = (64, 8), cosine: float = COSINE, smallest: int = SMALLEST) -> DataFrame:
    """The members of closed clusters of at least ``smallest`` nodes in which every two reach the cosine in both vectors.

    Clusters of at most PAIR_BLOCK nodes are compared in workers, many whole ones at once; larger ones by blocks.
    """
    split = widths[0]

    def mutual(rows: pa.Table) -> pa.Table:
        ids, of = rows["node_id"].to_numpy(), rows["cluster_id"].to_numpy()
        order = np.argsort(of, kind="stable")
        z = _matrix(rows["z"].combine_chunks(), sum(widths))
        starts = np.flatnonzero(np.insert(of[order[1:]] != of[order[:-1]], 0, True))
        kept = []
        for own in np.split(order, starts[1:]):
            x = z[own].astype(np.float64)
            if (x[:, :split] @ x[:, :split].T).min() >= cosine and (x[:, split:] @ x[:, split:].T).min() >= cosine:
                kept.append(own)
        kept = np.concatenate(kept) if kept else order[:0]
        return pa.table({"node_id": ids[kept], "cluster_id": of[kept]})

    closed = clusters.where("closed")
    sizes = stored(closed.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= smallest))
    n, largest = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    shares = max(clusters.sparkSession.sparkContext.defaultParallelism, math.ceil(n / CARRIED * 6))
    few = closed.join(sizes.where(F.col("size") <= PAIR_BLOCK), "cluster_id", "left_semi").withColumn("share", F.pmod(F.xxhash64("cluster_id"), F.lit(shares)))
    out = few.groupBy("share").applyInArrow(mutual, "node_id bigint, cluster_id bigint")
    if largest <= PAIR_BLOCK:
        return out
    many = closed.join(sizes.where(F.col("size") > PAIR_BLOCK), "cluster_id", "left_semi")
    return out.unionByName(_large_groups(many, widths, cosine))


def _large_groups(clusters: DataFrame, widths: tuple[int, int], cosine: float) -> DataFrame:
    """``mutual_groups`` of clusters of any size.

    Two members can't be further apart than their angles to the centre of the cluster together, so only pairs
    whose angles add up to more than the limit are compared. Clusters that a comparison with their outermost
    member already refutes are not compared any further.
    """
    width, split = sum(widths), widths[0]

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def angles(z: pa.Array, total: pa.Array) -> pa.Array:
        x, c = _matrix(z, width).astype(np.float64), _matrix(total, width).astype(np.float64)
        out = []
        for part in (slice(0, split), slice(split, width)):
            norm = np.maximum(np.linalg.norm(c[:, part], axis=1), 1e-12)
            out.append(np.arccos(np.clip((x[:, part] * c[:, part]).sum(1) / norm, -1, 1)))
        flat = pa.array(np.stack(out, 1).reshape(-1))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(x) + 1, 2, dtype=np.int32)), flat)

    least = _cosines(split, width)
    limit = math.acos(cosine) - 1e-6
    members = _centred(clusters, widths).withColumn("angle", angles("z", "total"))
    members = stored(members.select("cluster_id", "node_id", "z", F.col("angle")[0].alias("a"), F.col("angle")[1].alias("b")))
    widest = members.groupBy("cluster_id").agg(
        F.max("a").alias("most_a"), F.max("b").alias("most_b"), F.max_by("z", F.struct(F.col("a"), "node_id")).alias("za"), F.max_by("z", F.struct(F.col("b"), "node_id")).alias("zb")
    )
    apart = members.join(widest, "cluster_id").where((F.col("a") + F.col("most_a") > limit) | (F.col("b") + F.col("most_b") > limit))
    apart = stored(apart.withColumn("low", F.least(least("z", "za"), least("z", "zb"))))
    refuted = apart.where(F.col("low") < cosine).select("cluster_id").distinct()
    left = apart.join(refuted, "cluster_id", "left_anti").select("cluster_id", "node_id", "z", "a", "b")
    broken = _broken_clusters(left, widths, cosine)
    return members.join(refuted.unionByName(broken).distinct(), "cluster_id", "left_anti").select("node_id", "cluster_id")


def _broken_clusters(rows: DataFrame, widths: tuple[int, int], cosine: float) -> DataFrame:
    """Clusters with two members below the cosine, all pairs of each compared by blocks of its members."""
    width, split = sum(widths), widths[0]

    def apart(rows: pa.Table) -> pa.Table:
        z = _matrix(rows["z"].combine_chunks(), width).astype(np.float64)
        block = rows["block"].to_numpy()
        one, two = z[block == block.min()], z[block == block.max()]
        hit = any(np.minimum(one[i : i + 512, :split] @ two[:, :split].T, one[i : i + 512, split:] @ two[:, split:].T).min() < cosine for i in range(0, len(one), 512))
        return pa.table({"cluster_id": rows["cluster_id"].combine_chunks()[: int(hit)]})

    sizes = rows.groupBy("cluster_id").agg(F.ceil(F.count(F.lit(1)) / PAIR_BLOCK).alias("blocks"))
    placed = rows.join(sizes, "cluster_id").select("cluster_id", "z", F.pmod(F.xxhash64("node_id"), F.col("blocks")).alias("block"), "blocks")
    met = placed.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    pairs = met.select("cluster_id", "z", "block", F.least("block", "k").alias("low"), F.greatest("block", "k").alias("high"))
    return pairs.groupBy("cluster_id", "low", "high").applyInArrow(apart, "cluster_id bigint").distinct()


def describe(clusters: DataFrame, widths: tuple[int, int] = (64, 8), typical: int = TYPICAL) -> DataFrame:
    """``cluster_id, size, typical_rank, node_id, affinity``: the members nearest on average to all others."""
    width, split = sum(widths), widths[0]

    @F.arrow_udf(T.DoubleType())
    def affinity(z: pa.Array, total: pa.Array, size: pa.Array) -> pa.Array:
        x, c = _matrix(z, width).astype(np.float64), _matrix(total, width).astype(np.float64)
        n = size.to_numpy(zero_copy_only=False).astype(np.float64)
        return pa.array(((x * c).sum(1) - (x * x).sum(1)) / 2 / np.maximum(n - 1, 1))

    scored = _centred(clusters, widths).select("cluster_id", "size", "node_id", F.round(affinity("z", "total", "size"), 4).alias("affinity"))
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("affinity"), "node_id"))
    return scored.withColumn("typical_rank", rank).where(F.col("typical_rank") <= typical).select("cluster_id", "size", "typical_rank", "node_id", "affinity")


def node_clusters(embeddings: DataFrame, opinions: DataFrame, widths: tuple[int, int] = (64, 8), **how) -> DataFrame:
    """``spectral_clusters`` of the nodes that have both usable vectors."""
    nodes = stored(unit_vectors(embeddings, opinions, widths))
    return spectral_clusters(nodes, widths, **how)
