"""Readers of raw logs, splits, states, configurations and shards."""

from __future__ import annotations

import io
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored

RATING_SCHEMA = "source string, target string, weight double, timestamp double"
DATASETS = {
    "ratings_a": {"format": "rating_csv", "temporal": True},
    "ratings_b": {"format": "rating_csv", "temporal": True},
    "elections": {"format": "vote_blocks", "temporal": True},
    "adminship": {"format": "key_value", "temporal": True},
    "friends_foes": {"format": "edge_list", "temporal": False},
    "trust_web": {"format": "edge_list", "temporal": False},
}
ALIASES = {"ra": "ratings_a", "rb": "ratings_b", "el": "elections", "ad": "adminship", "ff": "friends_foes", "tw": "trust_web"}


def resolve_dataset(name: str) -> list[str]:
    """Dataset names behind a name, an alias or ``all``."""
    if name == "all":
        return list(DATASETS)
    name = ALIASES.get(name, name)
    if name not in DATASETS:
        raise KeyError(name)
    return [name]


def numbered_lines(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """``line_no, value``: the lines of text files with increasing numbers that follow file and place.

    The numbers have gaps between partitions; they order lines, which is all that is asked of them. Text is not
    split within a file here, since its order carries meaning, so a large log should come as several files.
    """
    rows = spark.read.option("encoding", encoding).text(path)
    rows = stored(rows.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), "value"))
    return rows.select(F.struct("file", "at").alias("line"), F.col("at").alias("line_no"), "value")


def read_rating_csv(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, source, target, weight, timestamp`` of headerless rating files; rows with nulls or weight 0 are dropped.

    Rows order by ``(timestamp, line_no)``, which makes ties definite.
    """
    rows = numbered_lines(spark, path)
    parsed = rows.select("line_no", F.from_csv("value", RATING_SCHEMA).alias("r")).select("line_no", "r.*")
    return parsed.dropna().where("weight <> 0")


def read_vote_blocks(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, source, target, weight, timestamp`` of blocks: a U line sets the target of the V lines below it.

    Short lines, other line types, unreadable or zero weights and unreadable dates are dropped. The target is
    carried down within a file; one file is one ordered log.
    """
    rows = spark.read.option("encoding", "iso-8859-1").text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_no"), F.split("value", "\t").alias("p"))
    return vote_blocks(rows)


def vote_blocks(rows: DataFrame) -> DataFrame:
    """The votes of ``file, line_no, p`` (parts of each line)."""
    part = lambda i: F.trim(F.try_element_at("p", F.lit(i)))
    header = F.when((part(1) == "U") & (F.size("p") >= 2), part(2))
    carried = F.last(header, ignorenulls=True).over(Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("target", carried).where((part(1) == "V") & (F.size("p") >= 4) & F.col("target").isNotNull())
    weight = F.try_to_number(part(2), F.lit("S999"))
    stamp = F.unix_timestamp(F.try_to_timestamp(part(4), F.lit("yyyy-MM-dd HH:mm:ss")))
    out = out.select("line_no", part(3).alias("source"), "target", weight.cast("double").alias("weight"), stamp.alias("timestamp"))
    return out.dropna().where("weight <> 0")


def read_key_value(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, source, target, weight, timestamp`` of records of ``KEY:value`` lines with blank lines between.

    SRC, TGT and VOT are needed and a vote of 0 is dropped. Times are forced to increase strictly within a file.
    """
    rows = spark.read.option("lineSep", "\n\n").text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_no"), "value")
    return key_value_records(rows)


def key_value_records(rows: DataFrame) -> DataFrame:
    """The records of ``file, line_no, value`` with the strictly increasing clock."""
    key = lambda k: F.when(F.col("value").rlike(rf"(?m)^{k}:"), F.trim(F.regexp_extract("value", rf"(?m)^{k}:(.*)$", 1)))
    parsed = rows.select("file", "line_no", key("SRC").alias("source"), key("TGT").alias("target"), key("VOT").alias("v"), key("YEA").alias("y"), key("DAT").alias("d"))
    parsed = parsed.withColumn("weight", F.expr("try_cast(v as double)")).where("source is not null and target is not null and weight is not null and weight <> 0")
    stamp = F.unix_timestamp(F.coalesce(*[F.try_to_timestamp("d", F.lit(f)) for f in ("HH:mm, d MMMM yyyy", "HH:mm, d MMM yyyy")]))
    year = F.unix_timestamp(F.try_to_timestamp(F.concat("y", F.lit("-01-01")), F.lit("yyyy-MM-dd")))
    parsed = parsed.withColumns({"candidate": stamp, "fallback": F.coalesce(year, F.lit(0))})
    return monotone_clock(parsed).select("line_no", "source", "target", "weight", "timestamp")


def monotone_clock(rows: DataFrame, log: str = "file", at: str = "line_no") -> DataFrame:
    """``rows`` with ``timestamp`` forced to increase strictly along each log.

    A candidate stands if it is later than the time before, else the time before plus 1 is taken, also where there
    is no candidate; a first row without one takes its fallback. As ``i + max(candidate_j - j)`` over the rows up
    to i this is a running maximum.
    """
    w = Window.partitionBy(log).orderBy(at)
    i = F.row_number().over(w)
    filled = rows.withColumn("__i", i).withColumn("__c", F.when(F.col("__i") == 1, F.coalesce("candidate", "fallback")).otherwise(F.col("candidate")))
    best = F.max(F.col("__c") - F.col("__i")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return filled.withColumn("timestamp", (best + F.col("__i")).cast("bigint")).drop("__i", "__c")


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, source, target, weight`` of white-space edge lists with # comments; loops and zeros are dropped."""
    return edge_list(numbered_lines(spark, path))


def edge_list(rows: DataFrame) -> DataFrame:
    parts = F.split(F.regexp_replace("value", r"^\s+", ""), r"\s+")
    number = lambda i: F.try_element_at(parts, F.lit(i)).cast("string")
    out = rows.where(~F.col("value").startswith("#")).select("line_no", number(1).alias("s"), number(2).alias("t"), number(3).alias("w"))
    out = out.select("line_no", F.expr("try_cast(s as bigint)").alias("source"), F.expr("try_cast(t as bigint)").alias("target"), F.expr("try_cast(w as double)").alias("weight"))
    return out.dropna().where("weight <> 0 and source <> target")


READERS = {"rating_csv": read_rating_csv, "vote_blocks": read_vote_blocks, "key_value": read_key_value, "edge_list": read_edge_list}


def read_raw(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """A raw log in one of the formats of READERS."""
    return READERS[fmt](spark, path)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """``path, sha256`` of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def check_checksum(spark: SparkSession, path: str, expected: str) -> None:
    if {r["sha256"] for r in checksums(spark, path).collect()} != {expected}:
        raise ValueError(f"the checksum of {path} is not the expected one")


@dataclass
class Splits:
    """The tables of one data set, lazily; ``test`` is an empty table of the same schema unless it is asked for."""

    train: DataFrame
    val: DataFrame
    test: DataFrame
    num_nodes: int
    extra: dict = field(default_factory=dict)

    @classmethod
    def load(cls, spark: SparkSession, root: str, read_test: bool = True) -> Splits:
        parts = {s: spark.read.parquet(f"{root}/{s}_events") for s in ("train", "val")}
        test = spark.read.parquet(f"{root}/test_events") if read_test else parts["val"].limit(0)
        manifest = read_json(spark, f"{root}/manifest").first().asDict(recursive=True)
        counts = manifest.get("counts") or manifest
        return cls(parts["train"], parts["val"], test, int(counts["num_nodes"]))


def read_state(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """``node_id, state``: vectors from Parquet, whichever column holds them; a table without one raises TypeError."""
    rows = spark.read.parquet(path)
    arrays = [c for c, kind in rows.dtypes if kind in ("array<float>", "array<double>")]
    if column is None and len(arrays) != 1 or column is not None and column not in arrays:
        raise TypeError(f"{path} has no single column of vectors")
    key = next(c for c, kind in rows.dtypes if kind == "bigint")
    return rows.select(F.col(key).alias("node_id"), F.col(column or arrays[0]).cast("array<double>").alias("state"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def read_shards(spark: SparkSession, pattern: str) -> DataFrame:
    """The union of shard files."""
    return spark.read.option("header", True).option("inferSchema", True).csv(pattern)


def discover_runs(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``experiment, seed, level, path`` of files ``root/experiment/seed/level/name``, parsed from their paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root).select("path")
    p = r"([^/]+)/([^/]+)/([^/]+)/[^/]+$"
    return files.select(*[F.regexp_extract("path", p, i + 1).alias(n) for i, n in enumerate(("experiment", "seed", "level"))], "path")


def resolve_selected(selected: DataFrame, seed: int) -> str:
    """The run directory selected for a seed; anything but exactly one row raises an error."""
    rows = selected.where(F.col("seed") == seed).select("run_dir").limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{len(rows)} selected runs for seed {seed}")
    return rows[0]["run_dir"]


def read_npy(spark: SparkSession, path: str, chunk: int = 10_000) -> DataFrame:
    """``node_id, state``: the rows of matrices stored as ``.npy``, numbered from 0 in each file. One file is one task."""

    def rows(frames):
        for frame in frames:
            for content in frame["content"]:
                matrix = np.load(io.BytesIO(content), allow_pickle=False)
                matrix = matrix.reshape(len(matrix), -1).astype(float)
                for first in range(0, len(matrix), chunk):
                    part = matrix[first : first + chunk]
                    yield pd.DataFrame({"node_id": np.arange(first, first + len(part)), "state": list(part)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "node_id bigint, state array<double>")


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """``name, shape, value``: the arrays of ``.npz`` files, flattened row by row; weights of stored probes, for example."""

    def arrays(frames):
        for frame in frames:
            for content in frame["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as parts:
                    for name in parts.files:
                        yield pd.DataFrame({"name": [name], "shape": [list(map(int, parts[name].shape))], "value": [parts[name].astype(float).ravel()]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(arrays, "name string, shape array<int>, value array<double>")
