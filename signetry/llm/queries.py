"""Queries of the training-data operators, with SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import usable_seconds
from ..session import spread, table
from .overlap import event_overlaps
from .mixing import mix
from .packing import fills, pack_all
from .pii import redacted, with_pii
from .spectral import describe, mutual_groups, node_clusters
from .survivors import Vote, consensus, survivors
from .tokens import VOCABULARY, token_count


# ---------------------------------------------------------------------------------- 2: survivors
def _pair_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    trust = (
        table(spark, sf_dir, "feeds")
        .where("feed_id is not null")
        .groupBy(F.col("feed_id").alias("__feed"))
        .agg(F.max("trust_level").alias("trust"))
    )
    events = table(spark, sf_dir, "train_events").where("source <> target")
    events = events.join(trust, F.col("feed_id") == F.col("__feed"), "left")
    return events.select(
        F.least("source", "target").alias("low"),
        F.greatest("source", "target").alias("high"),
        F.col("source"),
        F.col("target"),
        "event_id",
        "sign",
        "weight",
        usable_seconds(F.col("timestamp")).alias("second"),
        F.coalesce("trust", F.lit(0)).alias("trust"),
        "received_at",
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time, id and sign of each pair by the consensus of its events, whose tokens for them have weights of their own."""
    usable = F.col("second").isNotNull()
    second = F.coalesce("second", F.lit(-1))
    votes = [
        Vote("timestamp", F.col("second"), usable),
        Vote("event_id", F.col("event_id"), usable, (second,)),
        Vote("sign", F.col("sign"), F.col("sign").isin(1, -1), (F.col("trust"), second, F.col("received_at"), F.col("event_id"))),
    ]
    best = survivors(_pair_events(spark, sf_dir), ["low", "high"], votes, at_least=2)
    return best.where("timestamp is not null and sign is not null").select(F.col("low").alias("source"), F.col("high").alias("target"), "event_id", "sign", "timestamp")


def p2_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per pair the event nearest to the consensus of what its events say: direction, sign and weight, by trust."""
    events = _pair_events(spark, sf_dir)
    tokens = F.concat_ws(
        " ",
        F.concat(F.lit("from:"), F.col("source").cast("string")),
        F.concat(F.lit("to:"), F.col("target").cast("string")),
        F.concat(F.lit("sign:"), F.col("sign").cast("string")),
        F.concat(F.lit("weight:"), F.col("weight").cast("string")),
    )
    out = consensus(events, ["low", "high"], tokens, F.lit(1) + F.col("trust"), F.col("event_id"))
    return out.select(F.col("low").alias("source"), F.col("high").alias("target"), "n_values", "value", "distance", F.col("witness").alias("event_id"))


# ---------------------------------------------------------------------------------- 3: overlap of splits
def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits = {name: table(spark, sf_dir, f"{name}_events") for name in ("val", "test")}
    return event_overlaps(table(spark, sf_dir, "train_events"), splits, table(spark, sf_dir, "node_mapping"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlaps(spark, sf_dir).select("split_name", "train_event_id", "eval_event_id").distinct()


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps per split and canonical node: evaluation events concerned, overlaps, and those to the second."""
    each = _overlaps(spark, sf_dir)
    ends = each.select("split_name", F.explode(F.array("low", "high")).alias("node_id"), "eval_event_id", "seconds_apart")
    events = ends.groupBy("split_name", "node_id", "eval_event_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("seconds_apart") == 0, 1).otherwise(0)).alias("exact")
    )
    return events.groupBy("split_name", F.col("node_id").alias("source")).agg(
        F.count(F.lit(1)).alias("n_eval_events"), F.sum("n").alias("n_overlaps"), F.sum("exact").alias("n_same_second")
    )


# ---------------------------------------------------------------------------------- 6: clusters
def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return node_clusters(table(spark, sf_dir, "node_embeddings"), table(spark, sf_dir, "opinion_coordinates"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutual_groups(_clusters(spark, sf_dir))


def p6_typical(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = _clusters(spark, sf_dir)
    return describe(clusters.join(mutual_groups(clusters), ["node_id", "cluster_id"], "left_semi"))


# ---------------------------------------------------------------------------------- 7: containers
def _vocabulary(spark: SparkSession) -> str:
    """Rank file of the tokenizer, by the setting ``spark.signetry.vocabulary``."""
    return spark.conf.get("spark.signetry.vocabulary", VOCABULARY)


def p7_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sizes = documents.select("doc_id", token_count(F.col("text"), _vocabulary(spark)).alias("n_tokens"))
    kinds = table(spark, sf_dir, "token_containers").where("container_name is not null and capacity_tokens > 0")
    capacities = {r["container_name"]: r["capacity_tokens"] for r in kinds.orderBy("container_name").collect()}
    return pack_all(sizes, capacities)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fills(p7_assignment(spark, sf_dir))


# ---------------------------------------------------------------------------------- 8: mixture
def p8_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), vocabulary=_vocabulary(spark))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), vocabulary=_vocabulary(spark))[1]


# ---------------------------------------------------------------------------------- 9: personal information
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_pii(documents, table(spark, sf_dir, "name_parts")).select("doc_id", F.explode("pii").alias("s"))
    return found.select("doc_id", "s.pii_type", "s.pii_text").distinct()


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_pii(documents, table(spark, sf_dir, "name_parts"))
    return found.select("doc_id", redacted(F.col("text"), F.col("pii")).alias("text"), F.size("pii").alias("n_replaced"))


QUERIES = {f.__name__: f for f in (p2_found, p2_consensus, p3_found, p3_report, p6_found, p6_typical, p7_assignment, p7_fill, p8_chosen, p8_shares, p9_found, p9_redacted)}

_SECOND = """CASE WHEN "timestamp" <= 0 THEN NULL WHEN "timestamp" >= 100000000000000000 THEN "timestamp" // 1000000000
 WHEN "timestamp" >= 100000000000000 THEN "timestamp" // 1000000 WHEN "timestamp" >= 100000000000 THEN "timestamp" // 1000 ELSE "timestamp" END"""

_P3_BASE = f"""
WITH names AS (
  SELECT DISTINCT node_id, lower(translate(raw_node_id, ' _' || chr(9), '')) AS name FROM node_mapping WHERE raw_node_id IS NOT NULL AND node_id IS NOT NULL
), alias AS (
  SELECT node_id, min(first) AS canonical FROM names JOIN (SELECT name, min(node_id) AS first FROM names GROUP BY name) USING (name) GROUP BY node_id
), events AS (
  SELECT 'train' AS split_name, * FROM train_events UNION ALL SELECT 'val', * FROM val_events UNION ALL SELECT 'test', * FROM test_events
), nodes AS (
  SELECT split_name, event_id, coalesce(a.canonical, source) AS s, coalesce(b.canonical, target) AS t, {_SECOND} AS second
  FROM events LEFT JOIN alias a ON a.node_id = source LEFT JOIN alias b ON b.node_id = target
), usable AS (
  SELECT DISTINCT split_name, event_id, least(s, t) AS low, greatest(s, t) AS high, second FROM nodes WHERE s <> t AND second IS NOT NULL
), hits AS (
  SELECT DISTINCT e.split_name, t.event_id AS train_event_id, e.event_id AS eval_event_id, e.low, e.high, abs(t.second - e.second) AS apart
  FROM usable t JOIN usable e ON t.low = e.low AND t.high = e.high AND abs(t.second - e.second) <= 120
  WHERE t.split_name = 'train' AND e.split_name <> 'train'
)"""

ORACLE = {
    "p2_found": f"""
WITH e AS (
  SELECT least(source, target) AS low, greatest(source, target) AS high, event_id, sign, received_at, coalesce(trust_level, 0) AS trust, {_SECOND} AS second
  FROM train_events LEFT JOIN feeds USING (feed_id) WHERE source <> target
), groups AS (SELECT low, high, max(second) AS second FROM e GROUP BY low, high HAVING count(*) >= 2 AND max(second) IS NOT NULL),
stamps AS (SELECT low, high, second, max(event_id) AS event_id FROM e JOIN groups USING (low, high, second) GROUP BY low, high, second),
signs AS (
  SELECT low, high, sign FROM e WHERE sign IN (1, -1)
  QUALIFY row_number() OVER (PARTITION BY low, high ORDER BY trust DESC, coalesce(second, -1) DESC, received_at DESC NULLS LAST, event_id DESC NULLS LAST, sign DESC) = 1
)
SELECT low AS source, high AS target, event_id, sign, second AS "timestamp" FROM stamps JOIN signs USING (low, high)""",
    "p3_found": _P3_BASE + " SELECT DISTINCT split_name, train_event_id, eval_event_id FROM hits",
    "p3_report": _P3_BASE
    + """, ends AS (SELECT split_name, low AS source, eval_event_id, apart FROM hits UNION ALL SELECT split_name, high, eval_event_id, apart FROM hits)
SELECT split_name, source, count(DISTINCT eval_event_id) AS n_eval_events, count(*) AS n_overlaps,
  CAST(sum(CASE WHEN apart = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_same_second
FROM ends GROUP BY split_name, source""",
}
