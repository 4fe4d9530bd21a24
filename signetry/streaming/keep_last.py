"""The latest event per pair kept up to date over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import pair_high, pair_low


def streaming_latest(events: DataFrame, order: list[str], *carried: str) -> DataFrame:
    """``source, target`` and the carried columns of each pair's last event, as a streaming aggregation.

    It is the same mergeable state as in the batch form: a late event changes nothing unless it is the latest by
    ``order``, so no watermark is needed for the result to be right; the state is one row per pair.
    """
    last = F.max(F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], *carried))
    out = events.groupBy(pair_low().alias("low"), pair_high().alias("high")).agg(last.alias("last"))
    return out.select(F.col("low").alias("source"), F.col("high").alias("target"), *[F.col(f"last.{c}").alias(c) for c in carried])


def start_memory(latest: DataFrame, name: str, checkpoint: str | None = None) -> StreamingQuery:
    """The stream into an in-memory table, for tests and small results."""
    writer = latest.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def start_parquet(latest: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """The table of the latest events at ``path``, brought up to date with the pairs that each batch changes.

    The table lies in ``buckets`` parts by a hash of the pair. A batch brings its changed pairs only and rewrites
    the parts they fall into, each being replaced as a whole once its new files are written; a batch that is
    repeated after a failure gives the same table. ``read_parquet`` reads it.
    """
    from ..session import discard, stored

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        changed = stored(batch.withColumn("bucket", F.pmod(F.xxhash64("source", "target"), F.lit(buckets)).cast("int")))
        touched = [r["bucket"] for r in changed.select("bucket").distinct().collect()]  # at most as many as buckets
        if not touched:
            return
        whole = changed
        if _exists(spark, path):
            before = spark.read.schema(changed.schema).parquet(path).where(F.col("bucket").isin(touched))
            whole = stored(before.join(changed, ["source", "target"], "left_anti").select(changed.columns).unionByName(changed))
        whole.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        discard(changed)
        if whole is not changed:
            discard(whole)

    return latest.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``start_parquet`` keeps."""
    return spark.read.parquet(path).drop("bucket")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
