"""Queries of events, ids, topology and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import components, events, laplacian, splits
from ..operators.ranking import global_rank
from ..session import shared_root, stored, table
from ..sources.readers import edge_list, monotone_clock, vote_blocks
from ..streaming.keep_last import read_parquet, start_parquet, streaming_latest
from .inputs import EVENTS_SQL, SPARSE_SQL, TRADE_SQL, VECTOR_SQL, rating_events, rating_graph, registered, trade_graph, vector_graph


def valid_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.valid_events(table(spark, sf_dir, "train_events").select("event_id", "source", "target", "weight")).select("event_id", "source", "target", "weight", events.sign_of("weight").alias("sign"))


def keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rating_graph(spark, sf_dir)


def keep_last_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trade_graph(spark, sf_dir)


def _sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rating_events(spark, sf_dir).select("event_id", "source", "target", "weight", "ts").distinct()
    return global_rank(rows.withColumnRenamed("event_id", "log_id"), ["ts", "log_id", "source", "target", "weight"], "event_id")


def sequence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequence(spark, sf_dir).select("event_id", "log_id", "source", "target")


def first_seen_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.first_seen_ids(_sequence(spark, sf_dir))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rating_graph(spark, sf_dir).select(F.explode(F.array("source", "target")).alias("node_id")).distinct()


def dense_rank_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.sorted_ids(_nodes(spark, sf_dir))


def remapped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.apply_ids(rating_graph(spark, sf_dir), dense_rank_ids(spark, sf_dir)).select("source", "target", "sign")


def node_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation events between nodes that stand in the training graph."""
    return events.within_nodes(rating_events(spark, sf_dir, "val_events"), _nodes(spark, sf_dir)).select("event_id", "source", "target", "sign")


def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.graph_counts(rating_graph(spark, sf_dir)).withColumn("negative_share", F.round("negative_share", 6))


def layer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = rating_graph(spark, sf_dir).withColumn("weight", F.col("sign").cast("double"))
    out = [events.sign_layer(graph, p).select(F.lit(n).alias("layer"), "source", "target", "weight") for p, n in ((True, "positive"), (False, "negative"))]
    return out[0].unionByName(out[1])


def signed_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.weighted_degrees(rating_graph(spark, sf_dir)).withColumn("degree", F.round("degree", 6))


def canonical_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.weighted_degrees(trade_graph(spark, sf_dir)).withColumn("degree", F.round("degree", 6))


def message_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.message_edges(rating_graph(spark, sf_dir))


def signed_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.unit_adjacency(vector_graph(spark, sf_dir))


def laplacian_coo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return laplacian.laplacian_rows(laplacian.weighted_edges(rating_graph(spark, sf_dir))).withColumn("value", F.round("value", 6))


def negative_laplacian_coo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return laplacian.laplacian_rows(laplacian.negative_layer(rating_graph(spark, sf_dir))).withColumn("value", F.round("value", 6))


def restore_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = rating_events(spark, sf_dir)
    return events.check_restored(events.restore_direction(rating_graph(spark, sf_dir), log, ["ts", "event_id", "weight"]))


def two_hop_negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.hop_neighbours(vector_graph(spark, sf_dir), 2)


def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.fingerprint(rating_graph(spark, sf_dir))


def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.component_labels(vector_graph(spark, sf_dir, sparse=True))


def rating_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = components.component_labels(rating_graph(spark, sf_dir))
    return labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def lcc_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.restrict_to_largest(vector_graph(spark, sf_dir, sparse=True)).select("source", "target", "sign")


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    lcc = stored(events.restrict_to_largest(vector_graph(spark, sf_dir)))
    return global_rank(lcc, ["source", "target"], "event_id")


def spanning_tree_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = components.spanning_tree(_numbered(spark, sf_dir))
    return tree.agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("node_id").alias("n_nodes"))


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_snapshot(_numbered(spark, sf_dir), seed=0).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def pair_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.splits_disjoint(splits.split_snapshot(_numbered(spark, sf_dir), seed=0))


def split_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_snapshot(_numbered(spark, sf_dir), seed=0)


# ---------------------------------------------------------------------------------- log formats
def monotone_clock_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    second = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    rows = rows.select(F.col("event_type").alias("file"), F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 7 != 0, second).alias("candidate"), F.lit(0).cast("bigint").alias("fallback"))
    return monotone_clock(rows).select("file", "line_no", "timestamp")


def forward_fill_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    vote = F.array(F.lit("V"), F.when(F.col("value") > 50, "1").when(F.col("value") > 10, "-1").otherwise("0"), user, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    parts = F.when(F.col("event_id") % 10 == 0, F.array(F.lit("U"), user)).otherwise(vote)
    return vote_blocks(rows.select(F.col("event_type").alias("file"), F.col("event_id").alias("line_no"), parts.alias("p")))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "raw_rating_lines")
    return rows.select(F.col("line_id").alias("line_no"), F.translate(F.col("raw_line"), ",\r", "  ").alias("value"))


def edge_list_all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of every line; what does not parse is rejected by the reader alone."""
    return edge_list(_lines(spark, sf_dir))


def edge_list_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of the lines that the SQL splits alike: no quote, printable ASCII only."""
    lines = _lines(spark, sf_dir)
    return edge_list(lines.where(~F.col("value").contains('"') & ~F.col("value").rlike(r"[^\x20-\x7e]")))


def stream_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch result of ``keep_last`` from a stream over the same files."""
    root = shared_root(spark)
    import uuid

    path = f"{root}/{uuid.uuid4().hex}"
    source = f"{sf_dir}/train_events.parquet"
    schema = spark.read.parquet(source).schema
    rows = spark.readStream.schema(schema).parquet(source + "*").where("source <> target and weight <> 0")
    from ..functions.times import usable_seconds

    log = rows.select("event_id", "source", "target", "weight", F.signum("weight").cast("int").alias("sign"), F.coalesce(usable_seconds(F.col("timestamp")), F.lit(-1)).alias("ts"))
    start_parquet(streaming_latest(log, ["ts", "event_id", "weight"], "sign"), f"{path}/table", f"{path}/checkpoint").awaitTermination()
    return read_parquet(spark, f"{path}/table")


_BOTH = "SELECT source, target, sign FROM {0} UNION ALL SELECT target, source, sign FROM {0}"
_SEQ = f"WITH {EVENTS_SQL}, seq AS (SELECT row_number() OVER (ORDER BY ts, event_id, source, target, weight) - 1 AS event_id, event_id AS log_id, source, target FROM (SELECT DISTINCT event_id, source, target, weight, ts FROM ev))"
_NODES = f"WITH {EVENTS_SQL}, nodes AS (SELECT source AS node_id FROM phys UNION SELECT target FROM phys), ids AS (SELECT node_id AS raw_id, row_number() OVER (ORDER BY node_id) - 1 AS node_id FROM nodes)"
_DEGREE = """SELECT source AS node_id, round(sum(CASE WHEN sign > 0 THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END), 6) AS degree, count(*) FILTER (sign > 0) AS n_positive, count(*) FILTER (sign < 0) AS n_negative
FROM both_ GROUP BY source"""
_LCC = """reach(node_id, label) AS (SELECT source, source FROM g UNION SELECT target, target FROM g
  UNION SELECT e.target, r.label FROM reach r JOIN (SELECT source, target FROM g UNION SELECT target, source FROM g) e ON e.source = r.node_id),
labels AS (SELECT node_id, min(label) AS component FROM reach GROUP BY node_id)"""
_ROUNDED = "n AS (SELECT count(*) AS n FROM g)"

ORACLE = {
    "valid_ratings": f"WITH {EVENTS_SQL} SELECT event_id, source, target, weight, sign FROM ev",
    "keep_last": f"WITH {EVENTS_SQL} SELECT source, target, sign FROM phys",
    "stream_keep_last": f"WITH {EVENTS_SQL} SELECT source, target, sign FROM phys",
    "keep_last_trade": f"WITH {TRADE_SQL} SELECT source, target, CAST(sign AS INTEGER) AS sign FROM trade",
    "sequence_ids": _SEQ + " SELECT event_id, log_id, source, target FROM seq",
    "first_seen_ids": _SEQ
    + """, ends AS (SELECT source AS raw_id, 2 * event_id AS seen FROM seq UNION ALL SELECT target, 2 * event_id + 1 FROM seq), firsts AS (SELECT raw_id, min(seen) AS seen FROM ends GROUP BY raw_id)
SELECT raw_id, row_number() OVER (ORDER BY seen) - 1 AS node_id FROM firsts""",
    "dense_rank_ids": _NODES + " SELECT raw_id, node_id FROM ids",
    "remapped_edges": _NODES + " SELECT a.node_id AS source, b.node_id AS target, sign FROM phys JOIN ids a ON a.raw_id = source JOIN ids b ON b.raw_id = target",
    "node_membership": _NODES + " SELECT event_id, source, target, CAST(sign(weight) AS INTEGER) AS sign FROM val_events WHERE source <> target AND weight <> 0 AND source IN (SELECT node_id FROM nodes) AND target IN (SELECT node_id FROM nodes)",
    "graph_counts": f"WITH {EVENTS_SQL} SELECT count(*) AS n_edges, count(*) FILTER (sign > 0) AS n_positive, count(*) FILTER (sign < 0) AS n_negative, round(avg(CASE WHEN sign < 0 THEN 1 ELSE 0 END), 6) AS negative_share FROM phys",
    "layer_edges": f"WITH {EVENTS_SQL} SELECT CASE WHEN sign > 0 THEN 'positive' ELSE 'negative' END AS layer, source, target, 1.0::DOUBLE AS weight FROM phys",
    "signed_degree": f"WITH {EVENTS_SQL}, both_ AS ({_BOTH.format('phys')}) {_DEGREE}",
    "canonical_degree": f"WITH {TRADE_SQL}, both_ AS ({_BOTH.format('trade')}) {_DEGREE}",
    "message_edges": f"WITH {EVENTS_SQL} {_BOTH.format('phys')}",
    "signed_adjacency": f"WITH {VECTOR_SQL} SELECT source AS row, target AS col, CAST(sign AS INTEGER) AS value FROM ({_BOTH.format('g')})",
    "laplacian_coo": f"""WITH {EVENTS_SQL}, both_ AS ({_BOTH.format("phys")}), c AS (SELECT source, target, CASE WHEN sign > 0 THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS c FROM both_)
SELECT source AS row, target AS col, round(-sum(c), 6) AS value FROM c GROUP BY ALL UNION ALL SELECT source, source, round(sum(c), 6) FROM c GROUP BY source""",
    "negative_laplacian_coo": f"""WITH {EVENTS_SQL}, both_ AS ({_BOTH.format("phys")}), c AS (SELECT source, target, 1.0::DOUBLE AS c FROM both_ WHERE sign < 0)
SELECT source AS row, target AS col, round(-sum(c), 6) AS value FROM c GROUP BY ALL UNION ALL SELECT source, source, round(sum(c), 6) FROM c GROUP BY source""",
    "restore_direction": f"""WITH {EVENTS_SQL} SELECT source, target, sign, weight, event_id FROM (SELECT *, least(source, target) AS low, greatest(source, target) AS high FROM ev)
QUALIFY row_number() OVER (PARTITION BY low, high ORDER BY ts DESC, event_id DESC, weight DESC) = 1""",
    "two_hop_negative": f"""WITH {VECTOR_SQL}, both_ AS ({_BOTH.format("g")}), neg AS (SELECT DISTINCT source, target FROM both_ WHERE sign < 0),
hops AS (SELECT DISTINCT source AS node_id, target AS other, 1 AS distance FROM both_ UNION ALL SELECT DISTINCT a.source, b.target, 2 FROM neg a JOIN neg b ON a.target = b.source WHERE a.source <> b.target)
SELECT node_id, other, CAST(min(distance) AS INTEGER) AS distance FROM hops GROUP BY node_id, other""",
    "fingerprint": f"""WITH {EVENTS_SQL}, s AS (SELECT count(*) AS n_edges, CAST(sum(CAST(concat('0x', substr(md5(concat_ws(',', source, target, sign)), 1, 13)) AS BIGINT)) AS VARCHAR) AS digest FROM phys)
SELECT n_edges, digest, sha256(concat_ws('|', 'undirected', n_edges, digest)) AS fingerprint FROM s""",
    "connected_components": f"WITH RECURSIVE {SPARSE_SQL}, {_LCC} SELECT node_id, component FROM labels",
    "rating_components": f"""WITH RECURSIVE {EVENTS_SQL}, first AS (SELECT min(source) AS component FROM phys),
reach(node_id) AS (SELECT component FROM first UNION SELECT e.target FROM reach r JOIN (SELECT source, target FROM phys UNION SELECT target, source FROM phys) e ON e.source = r.node_id),
rest AS (SELECT count(*) AS n FROM (SELECT source FROM phys UNION SELECT target FROM phys) t(node_id) WHERE node_id NOT IN (SELECT node_id FROM reach))
SELECT component, (SELECT count(*) FROM reach) AS size FROM first, rest WHERE n = 0""",
    "lcc_edges": f"""WITH RECURSIVE {SPARSE_SQL}, {_LCC}, best AS (SELECT component FROM labels GROUP BY component ORDER BY count(*) DESC, component LIMIT 1),
ids AS (SELECT node_id AS raw_id, row_number() OVER (ORDER BY node_id) - 1 AS node_id FROM labels WHERE component IN (SELECT component FROM best))
SELECT a.node_id AS source, b.node_id AS target, CAST(sign AS INTEGER) AS sign FROM g JOIN ids a ON a.raw_id = source JOIN ids b ON b.raw_id = target""",
    "spanning_tree_size": f"WITH {VECTOR_SQL}, nodes AS (SELECT source AS node_id FROM g UNION SELECT target FROM g) SELECT count(*) - 1 AS n_edges, count(*) - 1 AS n_nodes FROM nodes",
    "split_counts": f"""WITH {VECTOR_SQL}, {_ROUNDED}, c AS (SELECT n, CAST(round_even(0.7::DOUBLE * n, 0) AS BIGINT) AS a, CAST(round_even(0.15::DOUBLE * n, 0) AS BIGINT) AS b FROM n)
SELECT 'train' AS split, a AS n FROM c UNION ALL SELECT 'val', b FROM c UNION ALL SELECT 'test', n - a - b FROM c""",
    "pair_disjoint": "SELECT 0::BIGINT AS n_shared",
    "monotone_clock": """WITH r AS (SELECT event_type AS file, event_id AS line_no, CASE WHEN event_id % 7 <> 0 THEN CAST(floor(epoch(ts)) AS BIGINT) END AS candidate, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events)
SELECT file, line_no, i + max(CASE WHEN i = 1 THEN coalesce(candidate, 0) ELSE candidate END - i) OVER (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS "timestamp" FROM r""",
    "forward_fill_blocks": """WITH r AS (SELECT *, last_value(CASE WHEN event_id % 10 = 0 THEN CAST(user_id AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS target FROM events)
SELECT event_id AS line_no, CAST(user_id AS VARCHAR) AS source, target, CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS weight, CAST(floor(epoch(ts)) AS BIGINT) AS "timestamp"
FROM r WHERE event_id % 10 <> 0 AND target IS NOT NULL AND value > 10""",
    "edge_list_lines": r"""WITH r AS (SELECT line_id AS line_no, translate(raw_line, ',' || chr(13), '  ') AS value FROM raw_rating_lines),
p AS (SELECT line_no, regexp_split_to_array(trim(value), '\s+') AS p FROM r WHERE NOT starts_with(value, '#') AND NOT contains(value, '"') AND NOT regexp_matches(value, '[^\x20-\x7e]'))
SELECT line_no, try_cast(p[1] AS BIGINT) AS source, try_cast(p[2] AS BIGINT) AS target, try_cast(p[3] AS DOUBLE) AS weight FROM p
WHERE regexp_full_match(p[1], '[+-]?[0-9]+') AND regexp_full_match(p[2], '[+-]?[0-9]+') AND try_cast(p[3] AS DOUBLE) <> 0 AND try_cast(p[1] AS BIGINT) <> try_cast(p[2] AS BIGINT)""",
}

_QUERIES = [
    valid_ratings, keep_last, keep_last_trade, sequence_ids, first_seen_ids, dense_rank_ids, remapped_edges, node_membership, graph_counts, layer_edges, signed_degree, canonical_degree, message_edges, signed_adjacency,
    laplacian_coo, negative_laplacian_coo, restore_direction, two_hop_negative, fingerprint, connected_components, rating_components, lcc_edges, spanning_tree_size, split_counts, pair_disjoint, split_snapshot,
    forward_fill_blocks, edge_list_all_lines, edge_list_lines, stream_keep_last,
]
WHOLE = {"signed_adjacency", "two_hop_negative", "spanning_tree_size", "split_counts", "pair_disjoint", "split_snapshot", "connected_components", "lcc_edges"}
QUERIES = registered(_QUERIES, ORACLE, WHOLE, set()) | {"monotone_clock": monotone_clock_query}
