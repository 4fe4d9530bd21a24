"""From a log of signed events to a canonical signed graph."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import conductance, pair_high, pair_low, sign_of
from .ranking import global_rank

HOP_EDGES = 5_000_000  # that workers hold to mark what each node reaches in two steps; joins beyond
HOP_ROWS = 500_000  # rows given on at a time


def valid_events(raw: DataFrame) -> DataFrame:
    """Rows with two different, non-blank endpoints and a number other than 0 as weight."""
    text = lambda c: F.trim(F.col(c).cast("string"))
    weight = F.expr("try_cast(weight AS double)")
    named = (text("source") != "") & (text("target") != "")
    return raw.withColumn("weight", weight).where(named & F.col("weight").isNotNull() & (F.col("weight") != 0) & (text("source") != text("target")))


def keep_last(events: DataFrame, order: list[str | Column], *carried: str) -> DataFrame:
    """One row per unordered pair: ``source < target`` and the columns of the last row in ``order``.

    The state of a pair is one row and merges before the shuffle, however often the pair occurs.
    """
    last = F.max(F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)], *carried))
    out = events.groupBy(pair_low().alias("low"), pair_high().alias("high")).agg(last.alias("last"))
    return out.select(F.col("low").alias("source"), F.col("high").alias("target"), *[F.col(f"last.{c}").alias(c) for c in carried])


def canonical_graph(events: DataFrame, order: list[str | Column]) -> DataFrame:
    """``source, target, sign`` of the physical undirected graph, the last event of a pair counting."""
    return keep_last(events.withColumn("sign", sign_of("weight")), order, "sign")


def build_events(raw: DataFrame, temporal: bool, line: str = "line_no") -> DataFrame:
    """Events with ``event_id`` and dense node ids from raw ``source, target, weight[, timestamp]`` and a line number.

    Temporal logs keep every event in order of time, then line. Static ones keep the last line of each unordered
    pair with its own orientation. Ids are given in order of first appearance, source before target.
    """
    valid = valid_events(raw).withColumns({c: F.trim(F.col(c).cast("string")) for c in ("source", "target")})
    if temporal:
        rows, order = valid, ["timestamp", line]
    else:
        last = F.max_by(F.struct(*[c for c in valid.columns if c != line], line), F.col(line))
        rows = valid.groupBy(pair_low().alias("__low"), pair_high().alias("__high")).agg(last.alias("__r")).select("__r.*")
        order = [line]
    numbered = global_rank(rows, order, "event_id")
    ids = first_seen_ids(numbered)
    return apply_ids(numbered.withColumn("sign", sign_of("weight")), ids)


def first_seen_ids(events: DataFrame) -> DataFrame:
    """``raw_id, node_id``: dense ids from 0 in order of first appearance over ``event_id``, source before target."""
    ends = events.select("event_id", F.posexplode(F.array("source", "target")).alias("at", "raw_id"))
    first = ends.groupBy("raw_id").agg(F.min(2 * F.col("event_id") + F.col("at")).alias("seen"))
    return global_rank(first, ["seen", "raw_id"], "node_id").select("raw_id", "node_id")


def sorted_ids(nodes: DataFrame) -> DataFrame:
    """``raw_id, node_id``: dense ids from 0 in order of the old ``node_id``."""
    return global_rank(nodes.select(F.col("node_id").alias("raw_id")).distinct(), ["raw_id"], "node_id")


def apply_ids(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Both endpoints replaced by their new ids; rows with an endpoint that has none are dropped."""
    s = ids.select(F.col("raw_id").alias("__s"), F.col("node_id").alias("__si"))
    t = ids.select(F.col("raw_id").alias("__t"), F.col("node_id").alias("__ti"))
    out = edges.join(s, F.col("source") == F.col("__s")).join(t, F.col("target") == F.col("__t"))
    return out.withColumns({"source": F.col("__si"), "target": F.col("__ti")}).drop("__s", "__si", "__t", "__ti")


def within_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both endpoints among ``nodes`` (node_id)."""
    one = nodes.select(F.col("node_id").alias("source"))
    return edges.join(one, "source", "left_semi").join(one.withColumnRenamed("source", "target"), "target", "left_semi").select(*edges.columns)


def restrict_to_largest(edges: DataFrame) -> DataFrame:
    """The largest component with its nodes numbered from 0 in the order of their old ids."""
    from .components import largest_component

    return apply_ids(edges, sorted_ids(largest_component(edges)))


def message_edges(edges: DataFrame) -> DataFrame:
    """Every physical edge in both directions, as one narrow step over the edges."""
    others = [c for c in edges.columns if c not in ("source", "target")]
    both = F.explode(F.array(F.struct(F.col("source").alias("s"), F.col("target").alias("t")), F.struct(F.col("target").alias("s"), F.col("source").alias("t"))))
    return edges.select(both.alias("e"), *others).select(F.col("e.s").alias("source"), F.col("e.t").alias("target"), *others)


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"source": F.col("target"), "target": F.col("source")})


def model_edges(edges: DataFrame, directed: bool) -> DataFrame:
    """Undirected models get the edges as they are, directed ones also reversed."""
    return edges.unionByName(reversed_edges(edges)) if directed else edges


def restore_direction(pairs: DataFrame, events: DataFrame, order: list[str]) -> DataFrame:
    """``pairs`` (source < target) with orientation, weight and event_id of their latest event.

    A pair without an event keeps nulls; ``check_restored`` raises on those.
    """
    latest = keep_last(
        events.withColumns({"from_node": F.col("source"), "to_node": F.col("target")}), order, "from_node", "to_node", "weight", "event_id"
    ).select(F.col("source").alias("__low"), F.col("target").alias("__high"), "from_node", "to_node", "weight", "event_id")
    joined = pairs.join(latest, (pairs["source"] == latest["__low"]) & (pairs["target"] == latest["__high"]), "left")
    kept = [c for c in pairs.columns if c not in ("source", "target", "weight", "event_id")]
    return joined.select(F.col("from_node").alias("source"), F.col("to_node").alias("target"), *[pairs[c] for c in kept], latest["weight"], latest["event_id"])


def check_restored(restored: DataFrame) -> DataFrame:
    """The same rows; reading one without an event raises an error."""
    bad = F.col("event_id").isNull()
    return restored.withColumn("event_id", F.when(bad, F.raise_error(F.lit("a pair has no event")).cast("bigint")).otherwise(F.col("event_id")))


def sign_layer(edges: DataFrame, positive: bool) -> DataFrame:
    """Edges of one sign; those of the negative layer carry their weights negated, so that they are positive."""
    layer = edges.where(F.col("sign") > 0 if positive else F.col("sign") < 0)
    return layer if positive or "weight" not in edges.columns else layer.withColumn("weight", -F.col("weight"))


def graph_counts(edges: DataFrame) -> DataFrame:
    """``n_edges, n_positive, n_negative, negative_share`` of a graph; an empty one has a null share."""
    negative = F.col("sign") < 0
    return edges.agg(
        F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("sign") > 0).alias("n_positive"), F.count_if(negative).alias("n_negative"), F.avg(negative.cast("int")).alias("negative_share")
    )


def weighted_degrees(edges: DataFrame, positive: float = 1.0, negative: float = 0.1) -> DataFrame:
    """``node_id, degree, n_positive, n_negative``: row sums of the conductances, and neighbours by sign."""
    doubled = message_edges(edges.select("source", "target", "sign")).withColumn("c", conductance("sign", positive, negative))
    return doubled.groupBy(F.col("source").alias("node_id")).agg(
        F.sum("c").alias("degree"), F.count_if(F.col("sign") > 0).alias("n_positive"), F.count_if(F.col("sign") < 0).alias("n_negative")
    )


def unit_adjacency(edges: DataFrame) -> DataFrame:
    """``row, col, value``: the symmetric adjacency with values -1 and 1."""
    return message_edges(edges.select("source", "target", "sign")).select(F.col("source").alias("row"), F.col("target").alias("col"), F.signum("sign").cast("int").alias("value"))


def hop_neighbours(edges: DataFrame, hops: int = 2) -> DataFrame:
    """``node_id, other, distance``: nodes within ``hops`` negative steps, the shortest distance, and positive neighbours.

    Positive edges are followed one step only, negative ones up to ``hops``, so that the enemies of enemies are
    among the candidates. Each further hop is an equi-join on the middle node; two hops over up to HOP_EDGES edges
    are marked by workers, four times as many where nodes are numbered from 0 without large gaps.
    """
    if hops == 2 and edges.schema["source"].dataType == edges.schema["target"].dataType == T.LongType():
        n, unknown, low, high = edges.agg(F.count(F.lit(1)), F.count_if(F.col("source").isNull() | F.col("target").isNull()), F.min(F.least("source", "target")), F.max(F.greatest("source", "target"))).first()
        numbered = n > 0 and not unknown and low >= 0 and high <= min(2 * n + 1_000, 2**31 - 2)
        if not unknown and n <= HOP_EDGES * (4 if numbered else 1):
            return _two_hops(edges, high + 1 if numbered else None)
    both = message_edges(edges.select("source", "target", "sign"))
    negative = both.where("sign < 0").select(F.col("source").alias("node_id"), F.col("target").alias("other")).distinct()
    layers = [both.select(F.col("source").alias("node_id"), F.col("target").alias("other")).distinct().withColumn("distance", F.lit(1))]
    reach = negative
    for distance in range(2, hops + 1):
        step = negative.select(F.col("node_id").alias("other"), F.col("other").alias("further"))
        reach = reach.join(step, "other").where("node_id <> further").select("node_id", F.col("further").alias("other")).distinct()
        layers.append(reach.withColumn("distance", F.lit(distance)))
    out = layers[0]
    for layer in layers[1:]:
        out = out.unionByName(layer)
    return out.groupBy("node_id", "other").agg(F.min("distance").alias("distance"))


def _two_hops(edges: DataFrame, n: int | None) -> DataFrame:
    """``hop_neighbours`` of two steps: workers hold the edges and mark what each node reaches, so no pair is made twice.

    ``n`` nodes are numbered from 0; without it the driver numbers them. Only the ends and signs go through the driver.
    """
    spark, kind = edges.sparkSession, "int" if n else "bigint"
    rows = edges.select(F.col("source").cast(kind), F.col("target").cast(kind), F.coalesce(F.col("sign") < 0, F.lit(False)).alias("negative")).toArrow()
    held = {k: rows[k].to_numpy() for k in rows.column_names}
    del rows
    if not n:
        held["ids"], at = np.unique(np.concatenate([held["source"], held["target"]]), return_inverse=True)
        n, at = len(held["ids"]), at.astype(np.int32)
        held["source"], held["target"] = np.split(at, 2)

    def neighbours(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = np.concatenate([a, b])
        return np.append(0, np.cumsum(np.bincount(own, minlength=n))), np.concatenate([b, a])[np.argsort(own, kind="stable")]

    shared = spark.sparkContext.broadcast(held)

    def reach(batches):
        held = shared.value
        if "near" not in held:  # once a worker
            bad = held["negative"]
            held["near"], held["enemies"] = neighbours(held["source"], held["target"]), neighbours(held["source"][bad], held["target"][bad])
        (ends, near), (bad, enemies), ids = held["near"], held["enemies"], held.get("ids")
        far = np.zeros(n, np.int8)
        for batch in batches:
            found: list[tuple] = []
            rows = 0
            for v in batch.column(0).to_pylist():
                far[:] = 0
                for u in enemies[bad[v] : bad[v + 1]]:
                    far[enemies[bad[u] : bad[u + 1]]] = 2
                far[v] = 0
                far[near[ends[v] : ends[v + 1]]] = 1
                hit = np.flatnonzero(far)
                found.append((np.full(len(hit), v if ids is None else ids[v]), hit if ids is None else ids[hit], far[hit].astype(np.int32)))
                rows += len(hit)
                if rows > HOP_ROWS:
                    yield pa.record_batch(dict(zip(("node_id", "other", "distance"), map(np.concatenate, zip(*found)))))
                    found, rows = [], 0
            if found:
                yield pa.record_batch(dict(zip(("node_id", "other", "distance"), map(np.concatenate, zip(*found)))))

    tasks = max(1, min(n, 12 * spark.sparkContext.defaultParallelism))
    places = spark.range(0, n, 1, tasks)
    return places.mapInArrow(reach, "node_id bigint, other bigint, distance int")


def fingerprint(edges: DataFrame, directed: bool = False) -> DataFrame:
    """One row ``n_edges, digest, fingerprint`` of the graph's ``(source, target, sign)`` triples, whatever their order.

    Undirected graphs are made canonical first, directed ones are taken with their repetitions. The digests of the
    triples are added up, which merges like any sum; no task ever holds or sorts the graph.
    """
    rows = edges.select("source", "target", F.col("sign").cast("bigint").alias("sign"))
    if not directed:
        rows = rows.select(pair_low().alias("source"), pair_high().alias("target"), "sign").distinct()
    hexed = F.md5(F.concat_ws(",", "source", "target", "sign"))
    part = F.conv(F.substring(hexed, 1, 13), 16, 10).cast("decimal(38,0)")
    tag = "directed" if directed else "undirected"
    sums = rows.agg(F.count(F.lit(1)).alias("n_edges"), F.coalesce(F.sum(part), F.lit(0).cast("decimal(38,0)")).alias("digest"))
    digest = F.col("digest").cast("string")
    return sums.select("n_edges", digest.alias("digest"), F.sha2(F.concat_ws("|", F.lit(tag), F.col("n_edges").cast("string"), digest), 256).alias("fingerprint"))


def fingerprint_bytes(edges: DataFrame, num_nodes: int, directed: bool = False, at_most: int = 20_000_000) -> str:
    """SHA-256 over the sorted 64-bit triples of a graph that fits on the driver, for comparison with stored digests."""
    import hashlib

    import numpy as np

    rows = edges.select("source", "target", F.col("sign").cast("bigint").alias("sign"))
    if not directed:
        rows = rows.select(pair_low().alias("source"), pair_high().alias("target"), "sign").distinct()
    if rows.limit(at_most + 1).count() > at_most:
        raise ValueError("too many edges for a byte-exact digest; use fingerprint")
    values = np.array([tuple(r) for r in rows.collect()], dtype="<i8").reshape(-1, 3)
    values = values[np.lexsort(values.T[::-1])]
    head = f"{'directed' if directed else 'undirected'}:{num_nodes}:{values.shape}".encode()
    return hashlib.sha256(head + values.tobytes()).hexdigest()
