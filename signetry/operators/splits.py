"""Connectivity-preserving splits of a snapshot and the checks that belong to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import hash_key
from .components import is_connected, spanning_tree
from .ranking import global_rank

RATIOS = (0.70, 0.15, 0.15)


def split_snapshot(edges: DataFrame, seed: int = 0, ratios: tuple[float, float, float] = RATIOS) -> DataFrame:
    """``edges`` (event_id, source, target, ...) with ``split``: train, val or test.

    All edges of a spanning tree from node 0 go to train, so that it stays connected. The others follow in an
    order hashed from the seed and the edge; train is filled to its rounded share, then val, the rest is test.
    """
    total = edges.count()
    tree = spanning_tree(edges.select("event_id", "source", "target")).select("event_id", F.lit(0).alias("__late"))
    n_train, n_val = round(ratios[0] * total), round(ratios[1] * total)
    if (n_tree := tree.count()) > n_train:
        raise ValueError(f"train is smaller than the spanning tree: {n_train} < {n_tree}")
    flagged = edges.join(tree, "event_id", "left").withColumns({"__late": F.coalesce("__late", F.lit(1)), "__key": hash_key(seed, "event_id")})
    ranked = global_rank(flagged, ["__late", "__key", "event_id"], "__rank")
    place = F.col("__rank")
    split = F.when(place < n_train, "train").when(place < n_train + n_val, "val").otherwise("test")
    return ranked.withColumn("split", split).drop("__late", "__key", "__rank")


def splits_disjoint(splits: DataFrame) -> DataFrame:
    """One row ``n_shared``: unordered pairs that stand in more than one split."""
    pairs = splits.select(F.least("source", "target").alias("low"), F.greatest("source", "target").alias("high"), "split").distinct()
    shared = pairs.groupBy("low", "high").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return shared.agg(F.count(F.lit(1)).alias("n_shared"))


def check_splits(splits: DataFrame, num_nodes: int) -> None:
    """Raise unless train is connected over all nodes and no pair stands in two splits."""
    if not is_connected(splits.where("split = 'train'"), num_nodes):
        raise ValueError("the training graph is not connected")
    if splits_disjoint(splits).first()[0]:
        raise ValueError("a pair stands in more than one split")
