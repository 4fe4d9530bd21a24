"""Per-key results when a handful of keys holds most rows.

Rows are combined where they are read: the aggregate's hash table keeps one mergeable state per key and
partition and spills when it is full, so a shuffle carries at most one compact state per key and map task,
however many rows a key has. Only algebraic aggregates are used; no key's rows are ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 0.03


def endpoint_states(edges: DataFrame) -> DataFrame:
    """``node_id, n_rows, n_positive, n_negative`` of every node over the rows it is source or target of.

    A row counts once for a node, also if it is both ends. Null endpoints belong to no node; a null or zero
    sign counts as a row of neither sign. Repeated rows count each time. An empty table gives no rows.
    """
    ends = F.array_distinct(F.array("source", "target"))
    sign = F.col("sign")
    rows = edges.select(
        F.explode(ends).alias("node_id"),
        F.when(sign > 0, 1).otherwise(0).alias("positive"),
        F.when(sign < 0, 1).otherwise(0).alias("negative"),
    ).where(F.col("node_id").isNotNull())
    return rows.groupBy("node_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("positive").alias("n_positive"), F.sum("negative").alias("n_negative")
    )


def hot_nodes(edges: DataFrame, share: float = HOT_SHARE) -> DataFrame:
    """The nodes that are source or target of at least ``share`` of all rows, with their states."""
    rows = edges.agg(F.count(F.lit(1)).alias("n")).scalar()
    states = endpoint_states(edges)
    return states.where(F.col("n_rows") >= F.lit(share) * rows)
