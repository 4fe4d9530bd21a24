"""Signed graphs taken from the input tables, as DataFrames and as SQL that gives the same rows."""

from __future__ import annotations

import functools
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import hash_uniform
from ..functions.times import usable_seconds
from ..operators.components import largest_component
from ..operators.events import apply_ids, canonical_graph, keep_last, sorted_ids
from ..operators.interventions import kmeans_communities
from ..session import stored, table

NODES = 500  # of the vector graph
COMMUNITIES = 10  # as many as the vectors have labels

SECOND_SQL = """CASE WHEN "timestamp" <= 0 THEN NULL WHEN "timestamp" >= 100000000000000000 THEN "timestamp" // 1000000000
 WHEN "timestamp" >= 100000000000000 THEN "timestamp" // 1000000 WHEN "timestamp" >= 100000000000 THEN "timestamp" // 1000 ELSE "timestamp" END"""


# ---------------------------------------------------------------------------------- rating events
def rating_events(spark: SparkSession, sf_dir: str, name: str = "train_events") -> DataFrame:
    """``event_id, source, target, weight, sign, ts`` of the valid events."""
    rows = table(spark, sf_dir, name).where("source <> target and weight <> 0")
    return rows.select("event_id", "source", "target", "weight", F.signum("weight").cast("int").alias("sign"), F.coalesce(usable_seconds(F.col("timestamp")), F.lit(-1)).alias("ts"))


def rating_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_last(rating_events(spark, sf_dir), ["ts", "event_id", "weight"], "sign")


EVENTS_SQL = f"""ev AS (
  SELECT event_id, source, target, weight, CAST(sign(weight) AS INTEGER) AS sign, coalesce({SECOND_SQL}, -1) AS ts
  FROM train_events WHERE source <> target AND weight <> 0
), phys AS (
  SELECT low AS source, high AS target, sign FROM (SELECT *, least(source, target) AS low, greatest(source, target) AS high FROM ev)
  QUALIFY row_number() OVER (PARTITION BY low, high ORDER BY ts DESC, event_id DESC, weight DESC) = 1
)"""


# ---------------------------------------------------------------------------------- trade graph
def trade_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("n")).scalar()
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.col("o_custkey").alias("source"),
        (customers + F.col("l_suppkey")).alias("target"),
        F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("weight"),
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', l_shipdate)").alias("ts"),
        "l_orderkey",
        "l_linenumber",
    )


ORDER = ["ts", "l_orderkey", "l_linenumber", "weight"]


def trade_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_graph(trade_events(spark, sf_dir), ORDER)


TRADE_SQL = """trade_ev AS (
  SELECT o_custkey AS source, (SELECT count(*) FROM customer) + l_suppkey AS target, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS weight,
    epoch_us(l_shipdate) AS ts, l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), trade AS (
  SELECT low AS source, high AS target, weight AS sign FROM (SELECT *, least(source, target) AS low, greatest(source, target) AS high FROM trade_ev)
  QUALIFY row_number() OVER (PARTITION BY low, high ORDER BY ts DESC, l_orderkey DESC, l_linenumber DESC, weight DESC) = 1
)"""


# ---------------------------------------------------------------------------------- whole network
_RUN: ContextVar[dict | None] = ContextVar("run over the whole network", default=None)


def over_network(query: Callable, connected: bool = False) -> Callable:
    """The query over the whole rating graph and the vectors of its nodes instead of the small vector graph.

    Nodes are numbered from 0; ``connected`` takes the largest component, for solvers.
    """

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        token = _RUN.set({"connected": connected})
        try:
            return query(spark, sf_dir)
        finally:
            _RUN.reset(token)

    return run


def registered(functions: list[Callable], oracle: dict[str, str], whole: set[str], connected: set[str]) -> dict[str, Callable]:
    """Queries by name; those in ``whole`` or ``connected`` run over the whole network.

    Where SQL checks the small graph the form over the network stands beside it as ``network_...``.
    """
    out = {f.__name__: f for f in functions}
    for name in [n for n in out if n in whole | connected]:
        out[f"network_{name}" if name in oracle else name] = over_network(out[name], name in connected)
    return out


def _network(spark: SparkSession, sf_dir: str) -> dict:
    """What the queries over the network share, made once a run."""
    run = _RUN.get()
    if "edges" not in run:
        graph = stored(rating_graph(spark, sf_dir))
        nodes = largest_component(graph) if run["connected"] else graph.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()
        run["ids"] = stored(sorted_ids(nodes))
        run["edges"] = stored(apply_ids(graph, run["ids"]).select("source", "target", "sign"))
    return run


def _network_vectors(spark: SparkSession, sf_dir: str, name: str, width: int) -> DataFrame:
    """``node_id, v``: a vector for every node of the network.

    Of several different usable vectors the greatest counts; a node without one (missing, of another width, with
    null or NaN) stands at the mean of the others, so that no node or edge is lost.
    """
    run = _network(spark, sf_dir)
    if name not in run:
        rows = table(spark, sf_dir, name).select(F.col("node_id").alias("raw_id"), F.col(name).cast("array<double>").alias("v"))
        fine = rows.where((F.size("v") == width) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
        own = stored(fine.groupBy("raw_id").agg(F.max("v").alias("v")).join(run["ids"], "raw_id").select("node_id", "v"))
        mean = own.agg(F.array(*[F.avg(F.col("v")[i]) for i in range(width)]).alias("mean"))  # one row
        every = run["ids"].select("node_id").join(own, "node_id", "left").join(F.broadcast(mean))
        run[name] = stored(every.select("node_id", F.coalesce("v", "mean").alias("v")))
    return run[name]


def node_count(spark: SparkSession, sf_dir: str) -> int:
    return NODES if _RUN.get() is None else _network(spark, sf_dir)["ids"].count()


# ---------------------------------------------------------------------------------- vector graph
def vector_graph(spark: SparkSession, sf_dir: str, sparse: bool = False) -> DataFrame:
    if _RUN.get() is not None:
        return rating_graph(spark, sf_dir) if sparse else _network(spark, sf_dir)["edges"]
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber = 1 and l_orderkey % 500 <> l_partkey % 500")
    if sparse:
        lines = lines.where("l_orderkey < 1500")
    rows = lines.select(
        (F.col("l_orderkey") % 500).alias("source"),
        (F.col("l_partkey") % 500).alias("target"),
        F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("weight"),
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', l_shipdate)").alias("ts"),
        "l_orderkey",
        "l_linenumber",
    )
    return canonical_graph(rows, ORDER)


def _vector_sql(name: str, extra: str = "") -> str:
    return f"""{name}_ev AS (
  SELECT l_orderkey % 500 AS source, l_partkey % 500 AS target, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS weight, epoch_us(l_shipdate) AS ts, l_orderkey, l_linenumber
  FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 500 <> l_partkey % 500{extra}
), {name} AS (
  SELECT low AS source, high AS target, weight AS sign FROM (SELECT *, least(source, target) AS low, greatest(source, target) AS high FROM {name}_ev)
  QUALIFY row_number() OVER (PARTITION BY low, high ORDER BY ts DESC, l_orderkey DESC, l_linenumber DESC, weight DESC) = 1
)"""


VECTOR_SQL = _vector_sql("g")
SPARSE_SQL = _vector_sql("g", " AND l_orderkey < 1500")


def vector_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``node_id, state`` of the vector graph's nodes."""
    if _RUN.get() is not None:
        return _network_vectors(spark, sf_dir, "node_embeddings", 64).withColumnRenamed("v", "state")
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id") < NODES)
    return rows.select(F.col("vec_id").alias("node_id"), F.col("embedding").cast("array<double>").alias("state"))


def short_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``node_id, value``: the first four numbers of the vectors, plain coordinates for queries that SQL checks.

    Over the network these are all eight opinion coordinates.
    """
    if _RUN.get() is not None:
        return _network_vectors(spark, sf_dir, "opinion_coordinates", 8).withColumnRenamed("v", "value")
    return vector_state(spark, sf_dir).select("node_id", F.slice("state", 1, 4).alias("value"))


def vector_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``node_id, community``: the labels of the vectors; over the network, which has none, clusters of the states."""
    if _RUN.get() is not None:
        run = _network(spark, sf_dir)
        if "labels" not in run:
            run["labels"] = stored(kmeans_communities(vector_state(spark, sf_dir), COMMUNITIES))
        return run["labels"]
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id") < NODES)
    return rows.select(F.col("vec_id").alias("node_id"), F.col("label").cast("int").alias("community"))


STATE_SQL = "st AS (SELECT vec_id AS node_id, CAST(i - 1 AS INTEGER) AS axis, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) r(i) WHERE vec_id < 500)"
LABEL_SQL = "part AS (SELECT vec_id AS node_id, CAST(label AS INTEGER) AS community FROM embeddings WHERE vec_id < 500)"


# ---------------------------------------------------------------------------------- hashed splits
def vector_splits(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The vector graph's edges dealt to train, val and test by a hash of the pair."""
    graph = vector_graph(spark, sf_dir).withColumn("u", hash_uniform("split", "source", "target"))
    low = {"train": 0.0, "val": 0.7, "test": 0.85}
    high = {"train": 0.7, "val": 0.85, "test": 1.0}
    return {s: graph.where((F.col("u") >= low[s]) & (F.col("u") < high[s])).drop("u") for s in low}


def uniform_sql(*parts: str) -> str:
    return f"(CAST(concat('0x', substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8)) AS BIGINT) / 4294967296.0)"


SPLIT_SQL = f"""sp AS (SELECT source, target, sign, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, {uniform_sql("'split'", "source", "target")} AS u FROM g))"""
