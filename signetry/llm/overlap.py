"""Records of evaluation splits that also stand, exactly or almost, in the training split.

An exact bipartite prefix-filter join: every record is a set of shingles, the rarest first. The first few
shingles of the evaluation records are indexed, the first few of the training records probe that index, pairs
whose sizes or positions rule out enough common shingles are dropped and the rest is verified.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import usable_seconds
from ..session import stored

SECONDS_APART = 120
GRIDS = 3  # of time; at most 4, whose number fits the last bits of a shingle
BROADCAST_ROWS = 300_000  # of two BIGINT columns


def _each(records: DataFrame) -> DataFrame:
    """``record, size, shingle``: one row per distinct shingle; a record is all columns but ``shingles``."""
    identity = F.struct(*[c for c in records.columns if c != "shingles"])
    own = records.select(identity.alias("record"), F.array_distinct(F.array_compact("shingles")).alias("own"))
    return own.select("record", F.size("own").alias("size"), F.explode("own").alias("shingle"))


def _ranked(known: DataFrame) -> DataFrame:
    """``record, size, shingles``: the shingles of each record that both sides have, the rarest first.

    ``size`` counts all shingles of the record. Those the other side lacks would come before all others and
    can't be shared, so only their number matters. Rows repeated as they were become one record.
    """
    ranked = known.groupBy("record").agg(F.max("size").alias("size"), F.array_sort(F.collect_set(F.struct("n", "shingle"))).alias("items"))
    return ranked.select("record", "size", F.col("items.shingle").alias("shingles"))


def _needed(size: Column, overlap: int | None, jaccard: float | None) -> Column:
    return F.lit(overlap) if overlap else F.ceil(F.lit(jaccard) * size - 1e-9).cast("int")


def _prefixes(ranked: DataFrame, side: str, overlap: int | None, jaccard: float | None) -> DataFrame:
    """One row per prefix shingle, with its place among all shingles of the record, the absent ones coming first."""
    absent = F.col("size") - F.size("shingles")
    length = F.col("size") - _needed(F.col("size"), overlap, jaccard) + 1 - absent
    able = ranked.where(F.size("shingles") >= _needed(F.col("size"), overlap, jaccard))
    first = able.select("*", absent.alias("absent"), F.slice("shingles", F.lit(1), F.greatest(length, F.lit(0))).alias("prefix"))
    at = first.select(F.struct("record", "shingles").alias(side), F.col("size").alias(f"{side}_size"), "absent", F.posexplode("prefix").alias("at", "shingle"))
    return at.withColumn(f"{side}_at", F.col("absent") + F.col("at")).drop("absent", "at")


def prefix_candidates(train: DataFrame, evaluation: DataFrame, overlap: int | None = None, jaccard: float | None = None) -> DataFrame:
    """Pairs that share a prefix shingle and that neither their sizes nor its places rule out, before verification.

    ``train, evaluation`` are structs of ``record`` (all columns but ``shingles``) and the ranked ``shingles``,
    ``least`` is the number of common shingles the pair needs.
    """
    if (overlap is None) == (jaccard is None):
        raise ValueError("give either overlap or jaccard")
    frequency = evaluation.select(F.explode(F.array_distinct("shingles")).alias("shingle")).where("shingle is not null")
    known = stored(_each(train).join(frequency.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")), "shingle"))
    shared = known.select("shingle", "n").distinct()
    probe = _prefixes(_ranked(known), "train", overlap, jaccard)
    index = _prefixes(_ranked(_each(evaluation).join(shared, "shingle")), "evaluation", overlap, jaccard)
    pairs = probe.join(index, "shingle")
    a, b = F.col("train_size"), F.col("evaluation_size")
    if jaccard:
        pairs = pairs.where((a >= b * jaccard - 1e-9) & (b >= a * jaccard - 1e-9))
    least = F.lit(overlap) if overlap else F.ceil((a + b) * F.lit(jaccard / (1 + jaccard)) - 1e-9).cast("int")
    pairs = pairs.where(1 + F.least(a - F.col("train_at") - 1, b - F.col("evaluation_at") - 1) >= least)
    return pairs.select("train", "evaluation", "shingle", least.alias("least"))


def prefix_join(train: DataFrame, evaluation: DataFrame, overlap: int | None = None, jaccard: float | None = None) -> DataFrame:
    """Pairs of a training and an evaluation record with at least ``overlap`` common shingles, or that similarity.

    Both tables have ``shingles`` (an array of any orderable type) and any other columns, which together are the
    record; the result has them as structs ``train`` and ``evaluation``, each pair once. Null and empty arrays
    match nothing, null and repeated shingles don't count, an empty table gives no rows. A pair that shares
    several prefix shingles is taken at the first of them, so nothing has to be made distinct.
    """
    pairs = prefix_candidates(train, evaluation, overlap, jaccard)
    common = F.array_intersect("train.shingles", "evaluation.shingles")
    verified = pairs.where((F.size(common) >= F.col("least")) & (common[0] == F.col("shingle")))
    return verified.select(F.col("train.record").alias("train"), F.col("evaluation.record").alias("evaluation"))


def node_aliases(mapping: DataFrame) -> DataFrame:
    """``node_id, canonical`` of the nodes that are the same as a smaller one.

    Nodes are the same if their raw ids differ only in letter case, spaces, tabs and underscores. Null ids say
    nothing. Where a node has several raw ids the relation is carried on from node to node.
    """
    plain = F.lower(F.translate("raw_node_id", " \t_", ""))
    names = mapping.where(F.col("node_id").isNotNull() & F.col("raw_node_id").isNotNull()).select("node_id", plain.alias("name")).distinct()
    several = names.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    first = names.groupBy("name").agg(F.min("node_id").alias("canonical"), F.count(F.lit(1)).alias("n"))
    shared = stored(names.join(first.where("n > 1").drop("n"), "name").select("node_id", "canonical"))
    if several.limit(1).count():
        from ..operators.components import component_labels

        links = shared.where("node_id <> canonical").select(F.col("node_id").alias("source"), F.col("canonical").alias("target"))
        labels = component_labels(links)
        return labels.where("node_id <> component").select("node_id", F.col("component").alias("canonical"))
    return shared.where("node_id <> canonical").distinct()


def canonical_events(events: DataFrame, aliases: DataFrame, few: bool) -> DataFrame:
    """``low, high, second, event_id`` of the events with a usable pair and timestamp, nodes by their canonical id."""
    out = events.select("event_id", "source", "target", usable_seconds(F.col("timestamp")).alias("second"))
    out = out.where(F.col("second").isNotNull() & F.col("source").isNotNull() & F.col("target").isNotNull() & F.col("event_id").isNotNull())
    for end in ("source", "target"):
        side = aliases.select(F.col("node_id").alias(end), F.col("canonical").alias(f"__{end}"))
        out = out.join(F.broadcast(side) if few else side, end, "left").withColumn(end, F.coalesce(f"__{end}", end)).drop(f"__{end}")
    return out.where("source <> target").select(F.least("source", "target").alias("low"), F.greatest("source", "target").alias("high"), "second", "event_id")


def event_overlaps(train: DataFrame, splits: dict[str, DataFrame], mapping: DataFrame, apart: int = SECONDS_APART) -> DataFrame:
    """``split_name, train_event_id, eval_event_id, low, high, seconds_apart`` of all overlaps.

    Time is cut by GRIDS grids of cells GRIDS * (apart + 1) wide, each shifted by apart + 1 against the one before.
    An event has one shingle per grid, its node pair with its cell. Between two events at most ``apart`` seconds
    from each other lies the border of one grid at most, so they share all shingles but one, which is the overlap
    asked for; the exact difference decides. Hot pairs are split by their cells. Rows repeated as they were give
    the overlap once. Null or unusable endpoints and timestamps overlap with nothing.
    """
    aliases = stored(node_aliases(mapping))
    few = aliases.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS

    def shingled(events: DataFrame) -> DataFrame:
        cells = [F.expr(f"(second + {k * (apart + 1)}) div {GRIDS * (apart + 1)}") for k in range(GRIDS)]
        hashed = [F.shiftleft(F.xxhash64("low", "high", c), 2).bitwiseOR(F.lit(k).cast("bigint")) for k, c in enumerate(cells)]
        return events.withColumn("shingles", F.array(*hashed))  # the grid in the last bits, so that grids never meet

    evaluation = None
    for name, events in splits.items():
        own = canonical_events(events, aliases, few).withColumn("split_name", F.lit(name))
        evaluation = own if evaluation is None else evaluation.unionByName(own)
    pairs = prefix_join(shingled(canonical_events(train, aliases, few)), shingled(evaluation), overlap=GRIDS - 1)
    difference = F.abs(F.col("train.second") - F.col("evaluation.second"))
    same = (F.col("train.low") == F.col("evaluation.low")) & (F.col("train.high") == F.col("evaluation.high"))
    out = pairs.where(same & (difference <= apart)).select(
        "evaluation.split_name",
        F.col("train.event_id").alias("train_event_id"),
        F.col("evaluation.event_id").alias("eval_event_id"),
        "evaluation.low",
        "evaluation.high",
        difference.alias("seconds_apart"),
    )
    return out.distinct()
