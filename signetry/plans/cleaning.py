"""Queries of the general data-cleaning operators, with SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import with_utc
from ..operators.hotkeys import endpoint_states, hot_nodes
from ..session import spread, table
from ..sources.structural import ratings, rejects


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "raw_rating_lines").select("line_id", "raw_line")
    return rejects(lines).select("line_id", "reason").distinct()


def p1_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "raw_rating_lines").select("line_id", "feed_id", "raw_line")
    return ratings(lines, keep=("line_id", "feed_id")).select(
        "line_id", "feed_id", "source", "target", F.col("weight"), F.round("timestamp", 6).alias("timestamp")
    )


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = table(spark, sf_dir, "raw_votes").select("record_id", "feed_id", "timestamp")
    return with_utc(votes, table(spark, sf_dir, "feeds"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _votes(spark, sf_dir).where(F.col("utc_micros").isNotNull()).select("record_id", "utc_micros").distinct()


def p4_without_instant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _votes(spark, sf_dir).where(F.col("utc_micros").isNull()).select("record_id", F.col("utc_reason").alias("reason")).distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hot_nodes(table(spark, sf_dir, "train_snapshot_undirected")).select("node_id")


def p5_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return endpoint_states(table(spark, sf_dir, "train_snapshot_undirected"))


QUERIES = {f.__name__: f for f in (p1_found, p1_ratings, p4_found, p4_without_instant, p5_found, p5_nodes)}

_FIELD = r'"(?:[^"]|"")*"|[^",]*'
_P1_BASE = rf"""
WITH lines AS (
  SELECT line_id, feed_id, regexp_replace(raw_line, '\r$', '') AS line FROM raw_rating_lines
  WHERE regexp_matches(coalesce(raw_line, ''), '[^\s]') AND NOT starts_with(raw_line, '#')
), quoted AS (
  SELECT *, regexp_full_match(line, '(?s)({_FIELD})(,({_FIELD}))*') AS well_quoted,
    len(string_split(regexp_replace(line, '"(?:[^"]|"")*"', 'q', 'g'), ',')) AS n_fields,
    regexp_extract(line, '(?s)^({_FIELD}),({_FIELD}),({_FIELD}),({_FIELD})$', ['a', 'b', 'c', 'd']) AS f
  FROM lines
), plain AS (
  SELECT line_id, feed_id, well_quoted, n_fields,
    trim(replace(regexp_replace(f.a, '(?s)^"(.*)"$', '\1'), '""', '"'), ' ') AS source,
    trim(replace(regexp_replace(f.b, '(?s)^"(.*)"$', '\1'), '""', '"'), ' ') AS target,
    trim(replace(regexp_replace(f.c, '(?s)^"(.*)"$', '\1'), '""', '"'), ' ') AS weight,
    trim(replace(regexp_replace(f.d, '(?s)^"(.*)"$', '\1'), '""', '"'), ' ') AS stamp
  FROM quoted
), judged AS (
  SELECT *, CASE WHEN NOT well_quoted THEN 'quoting' WHEN n_fields <> 4 THEN 'column_count'
    WHEN lower(source) IN ('', 'null', 'na', 'nan') OR regexp_matches(source, '[\x00-\x1f\x7f-\x{{9f}}\x{{fffd}}]') THEN 'bad_source'
    WHEN NOT regexp_full_match(weight, '[+-]?0*(10|[0-9])') THEN 'bad_weight'
    WHEN NOT regexp_full_match(stamp, '0*[0-9]{{1,10}}(\.[0-9]+)?') OR CAST(split_part(stamp, '.', 1) AS BIGINT) NOT BETWEEN 946684800 AND 1893455999 THEN 'bad_timestamp'
    END AS reason
  FROM plain
)"""

ORACLE = {
    "p1_found": _P1_BASE + " SELECT DISTINCT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p1_ratings": _P1_BASE
    + """ SELECT line_id, feed_id, source, target, CAST(weight AS INTEGER) AS weight, round(CAST(stamp AS DOUBLE), 6) AS "timestamp"
    FROM judged WHERE reason IS NULL""",
    "p5_nodes": """
SELECT node_id, count(*) AS n_rows, CAST(sum(CASE WHEN sign > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_positive,
  CAST(sum(CASE WHEN sign < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_negative
FROM (SELECT source AS node_id, sign FROM train_snapshot_undirected WHERE source IS NOT NULL
  UNION ALL SELECT target, sign FROM train_snapshot_undirected WHERE target IS NOT NULL AND source IS DISTINCT FROM target)
GROUP BY node_id""",
    "p5_found": """
SELECT node_id FROM (SELECT source AS node_id FROM train_snapshot_undirected WHERE source IS NOT NULL
  UNION ALL SELECT target FROM train_snapshot_undirected WHERE target IS NOT NULL AND source IS DISTINCT FROM target)
GROUP BY node_id HAVING count(*) >= 0.03 * (SELECT count(*) FROM train_snapshot_undirected)""",
}
