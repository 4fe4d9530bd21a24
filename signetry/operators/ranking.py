"""Sequence numbers over a whole table without one task that sorts it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def global_rank(rows: DataFrame, order: list[str | Column], name: str, start: int = 0) -> DataFrame:
    """``rows`` with ``name`` counting from ``start`` in the given order, which should be unique.

    Rows are range-partitioned, ranked within their partition and moved up by the number of rows before it.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    # one row per partition, a number set by configuration
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = ranged.withColumn("__own", own).join(before.drop("__n"), "__part")
    return ranked.withColumn(name, (F.col("__own") + F.coalesce("__before", F.lit(0)) + (start - 1)).cast("bigint")).drop("__part", "__own", "__before")
