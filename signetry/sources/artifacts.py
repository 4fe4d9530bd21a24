"""Sinks for data sets, graphs and records, with guards against overwriting and against stale results."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.events import fingerprint, keep_last, model_edges, restore_direction

VERSION = 1


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def write_table(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Parquet through Spark's commit protocol; an existing path is an error unless ``overwrite`` is set."""
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def write_record(spark: SparkSession, record: dict, path: str, overwrite: bool = True) -> None:
    """One JSON record; nested values keep their structure."""
    rows = spark.createDataFrame([(json.dumps(record, sort_keys=True, default=str),)], "value string").coalesce(1)
    rows.write.mode("overwrite" if overwrite else "errorifexists").text(path)


def read_record(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def patch_record(spark: SparkSession, path: str, **changes) -> dict:
    """A record read, changed and written back."""
    record = read_record(spark, path) | changes
    write_record(spark, record, path)
    return record


def write_dataset(splits: DataFrame, events: DataFrame, mapping: DataFrame, path: str, order: list[str], overwrite: bool = False) -> dict:
    """Split events, train snapshots in both forms, node mapping and manifest of a split snapshot.

    Directions and weights come from the latest event of each pair; in the undirected snapshot the weight is the
    sign. The manifest counts edges and signs per split.
    """
    spark = splits.sparkSession
    if path_exists(spark, f"{path}/manifest") and not overwrite:
        raise FileExistsError(path)
    counts = {r["split"]: r.asDict() for r in splits.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("sign") > 0).alias("pos"), F.count_if(F.col("sign") < 0).alias("neg")).collect()}
    for split in ("train", "val", "test"):
        own = restore_direction(splits.where(F.col("split") == split).select("source", "target", "sign"), events, order)
        write_table(own, f"{path}/{split}_events", overwrite)
    train = splits.where("split = 'train'").select("source", "target", "sign")
    write_table(restore_direction(train, events, order), f"{path}/train_snapshot_directed", overwrite)
    write_table(train.withColumn("weight", F.col("sign").cast("double")), f"{path}/train_snapshot_undirected", overwrite)
    write_table(mapping, f"{path}/node_mapping", overwrite)
    manifest = {
        "schema_version": VERSION,
        "counts": {
            "num_nodes": mapping.count(),
            "splits": {k: v["n"] for k, v in counts.items()},
            "positive": {k: v["pos"] for k, v in counts.items()},
            "negative": {k: v["neg"] for k, v in counts.items()},
        },
        "fingerprint": fingerprint(train).first()["fingerprint"],
    }
    write_record(spark, manifest, f"{path}/manifest")
    return manifest


def write_augmented(additions: DataFrame, directed_base: DataFrame, undirected_base: DataFrame, path: str, directed: bool, overwrite: bool = False) -> None:
    """New physical edges, new model edges and both augmented snapshots; columns the additions lack are null."""
    new = additions.select("source", "target", F.lit(1).alias("sign"), F.lit(1.0).alias("weight"))
    model = model_edges(new, directed)
    write_table(new, f"{path}/new_physical_edges", overwrite)
    write_table(model, f"{path}/new_model_edges", overwrite)
    write_table(directed_base.unionByName(model, allowMissingColumns=True), f"{path}/augmented_directed", overwrite)
    write_table(undirected_base.unionByName(new, allowMissingColumns=True), f"{path}/augmented_undirected", overwrite)


def write_communities(packed: DataFrame, path: str, overwrite: bool = False) -> None:
    """Packed communities of one seed as CSV."""
    packed.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


def write_state(state: DataFrame, path: str, overwrite: bool = False) -> None:
    """Node states (node_id, state), or any vectors, as Parquet arrays."""
    write_table(state, path, overwrite)


def save_model(model, path: str, overwrite: bool = False) -> None:
    (model.write().overwrite() if overwrite else model.write()).save(path)


def prune_runs(runs: DataFrame, selected: DataFrame) -> list[str]:
    """Delete the directories of runs that were not selected; their paths are returned."""
    lost = [r["run_dir"] for r in runs.select("run_dir").distinct().join(selected.select("run_dir"), "run_dir", "left_anti").collect()]
    for path in lost:
        delete_path(runs.sparkSession, path)
    return sorted(lost)


# ---------------------------------------------------------------------------------- provenance
class StaleResult(RuntimeError):
    """A stored result belongs to other inputs."""


def state_fingerprint(state: DataFrame) -> str:
    """Digest of vectors by node, whatever the order of rows."""
    key = F.md5(F.concat_ws(",", F.col("node_id").cast("string"), F.transform("state", lambda x: x.cast("string"))))
    part = F.conv(F.substring(key, 1, 13), 16, 10).cast("decimal(38,0)")
    n, digest = state.agg(F.count(F.lit(1)), F.sum(part)).first()
    return f"{n}:{digest}"


def reusable(spark: SparkSession, path: str, wanted: dict) -> bool:
    """Whether a record stands at the path with these values; one with others raises StaleResult."""
    if not path_exists(spark, path):
        return False
    record = read_record(spark, path)
    wrong = [k for k, v in wanted.items() if record.get(k) != v]
    if wrong:
        raise StaleResult(f"{path} differs in {', '.join(wrong)}")
    return True


def resumable_run(record: dict | None, wanted: dict) -> bool:
    """A tuning run is taken again if everything matches and it never saw the test split."""
    return record is not None and all(record.get(k) == v for k, v in wanted.items()) and not any(k.startswith("test_") for k in record)


def check_measurement(record: dict, graph: str, state: str, eta: float, alpha: float) -> None:
    """Raise unless a measurement was made of this graph and state with these parameters."""
    wanted = {"graph_fingerprint": graph, "state_fingerprint": state, "negative_conductance": eta, "antagonistic_weight": alpha, "schema_version": VERSION}
    wrong = [k for k, v in wanted.items() if record.get(k) != v]
    if wrong:
        raise StaleResult(f"the measurement differs in {', '.join(wrong)}")


def cached_table(spark: SparkSession, root: str, key: str, make) -> DataFrame:
    """The table kept under a key such as a fingerprint, made and written the first time.

    It is written beside its place and renamed, so nobody reads half a table; of several writers the first stays.
    """
    path = f"{root}/{key}"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        beside = f"{root}/.{key}.{uuid.uuid4().hex}"
        write_table(make(), beside)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        files = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if path_exists(spark, path) or not files.rename(hadoop(beside), hadoop(path)):
            delete_path(spark, beside)
    return spark.read.parquet(path)


def latest_events(events: DataFrame, order: list[str]) -> DataFrame:
    """One row per pair with the sign of its latest event."""
    return keep_last(events, order, "sign")
