"""Session helpers: table access, shared-folder tables that cut lineage, and input spreading."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, lazily."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """Folder for intermediate tables that every executor can read.

    It is the one named by ``spark.checkpoint.dir``. A local session without that setting gets a folder of its
    own, a cluster without it raises an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="signetry-")
        _ROOTS[app] = f"{base.rstrip('/')}/signetry-{app}"
        atexit.register(_remove, spark, _ROOTS[app])
    return _ROOTS[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001 - the session is gone already
        pass


def stored(df: DataFrame, *partition_hint: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that its lineage ends there.

    The files survive the loss of any executor. ``partition_hint`` names columns to cluster rows by first.
    """
    path = f"{shared_root(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    (df.repartition(*partition_hint) if partition_hint else df).write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._signetry_path = path
    return back


def discard(df: DataFrame) -> None:
    """Remove the files behind a table made by ``stored`` once nothing reads it any more."""
    if path := getattr(df, "_signetry_path", None):
        _remove(df.sparkSession, path)


def spread(df: DataFrame, per_core: int = 3) -> DataFrame:
    """Even out a scan that has fewer partitions than the cluster has cores before costly per-row Python work.

    A table with enough splits, as any large one has, is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(per_core * cores) if df.rdd.getNumPartitions() < 2 * cores else df
