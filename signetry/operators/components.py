"""Connected components, spanning trees and connectivity of undirected graphs, as rounds of joins.

Every round is written to the shared folder, so lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored

MAX_ROUNDS = 60
LOCAL_EDGES = 4_000_000  # distinct pairs up to which one task labels them all


def _pairs(edges: DataFrame) -> DataFrame:
    edges = edges.where("source is not null and target is not null")
    plain = edges.select(F.greatest("source", "target").alias("u"), F.least("source", "target").alias("v"))
    return plain.where("u <> v").distinct()


def _summary(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is linked to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _labels_in_one_task(pairs: DataFrame) -> DataFrame:
    """Smallest reachable node of every node, by minima along the edges and pointer jumping over arrays."""

    def run(frames):
        parts = [f[["u", "v"]].to_numpy() for f in frames if len(f)]
        if not parts:
            return
        ids, at = np.unique(np.concatenate(parts), return_inverse=True)
        a, b = at.reshape(-1, 2).T
        label = np.arange(len(ids))
        while True:
            least = np.minimum(label[a], label[b])
            following = label.copy()
            np.minimum.at(following, label[a], least)
            np.minimum.at(following, label[b], least)
            following = following[following]
            if (following == label).all():
                break
            label = following
        yield pd.DataFrame({"node_id": ids, "component": ids[label]})

    return pairs.coalesce(1).mapInPandas(run, "node_id bigint, component bigint")


def component_labels(edges: DataFrame) -> DataFrame:
    """``node_id, component`` of every node with an edge to another; the component is its smallest node.

    ``edges`` has ``source, target``. Null endpoints, loops and repeated edges change nothing; no edges give no
    rows. Up to LOCAL_EDGES pairs one task labels them. Beyond that alternating large and small stars end after a
    number of rounds that grows with the logarithm of the largest component.
    """
    current = stored(_pairs(edges))
    if current.limit(LOCAL_EDGES + 1).count() <= LOCAL_EDGES:
        return stored(_labels_in_one_task(current))
    before = None
    for _ in range(MAX_ROUNDS):
        now = _summary(current)
        if now == before:
            break
        before = now
        wide = stored(_large_star(current))
        following = stored(_small_star(wide))
        discard(wide)
        discard(current)
        current = following
    else:
        raise RuntimeError("components did not settle")
    leaves = current.select(F.col("u").alias("node_id"), F.col("v").alias("component"))
    return leaves.unionByName(leaves.select(F.col("component").alias("node_id"), "component").distinct())


def with_isolated(labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """``labels`` with every other node of ``nodes`` (node_id) as a component of its own."""
    rest = nodes.select("node_id").distinct().join(labels, "node_id", "left_anti")
    return labels.unionByName(rest.select("node_id", F.col("node_id").alias("component")))


def largest_component(edges: DataFrame) -> DataFrame:
    """``node_id`` of the largest component; of equally large ones that with the smallest node."""
    labels = component_labels(edges)
    best = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return labels.join(F.broadcast(best), "component", "left_semi").select("node_id")


def is_connected(edges: DataFrame, num_nodes: int) -> bool:
    """Whether all nodes 0..num_nodes-1 hang together; no nodes, or one without an edge among several, do not."""
    if num_nodes <= 0:
        return False
    if num_nodes == 1:
        return True
    found = component_labels(edges).agg(F.count(F.lit(1)), F.countDistinct("component")).first()
    return tuple(found) == (num_nodes, 1)


def spanning_tree(edges: DataFrame, root: int = 0) -> DataFrame:
    """``event_id, node_id, parent, depth``: one tree edge per node that the root reaches, found level by level.

    ``edges`` has ``event_id, source, target``. A node reached over several edges of one level takes the one with
    the smallest ``(parent, event_id)``.
    """
    doubled = edges.select("event_id", F.col("source").alias("a"), F.col("target").alias("b"))
    doubled = stored(doubled.unionByName(doubled.select("event_id", F.col("b").alias("a"), F.col("a").alias("b"))))
    spark = edges.sparkSession
    tree = spark.createDataFrame([(None, root, None, 0)], "event_id bigint, node_id bigint, parent bigint, depth int")
    levels, frontier, depth = [tree], tree.select("node_id"), 0
    seen = tree.select("node_id")
    while True:
        depth += 1
        step = doubled.join(frontier, doubled.a == frontier.node_id).drop("node_id").join(seen, F.col("b") == seen.node_id, "left_anti")
        level = step.groupBy(F.col("b").alias("node_id")).agg(F.min(F.struct(F.col("a").alias("parent"), "event_id")).alias("e"))
        level = stored(level.select("e.event_id", "node_id", "e.parent", F.lit(depth).alias("depth")))
        if level.isEmpty():
            break
        levels.append(level)
        frontier = level.select("node_id")
        seen = stored(seen.unionByName(frontier))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.where("event_id is not null")
