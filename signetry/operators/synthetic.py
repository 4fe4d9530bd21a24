"""Synthetic signed graphs with known structure, opinions and reports over panels of them.

All randomness is a hash of the seed and the row's own key, so a graph is the same on any cluster and levels of a
panel share their draws.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import hash_key, hash_uniform
from ..session import stored
from .components import is_connected


def balanced_communities(spark: SparkSession, n: int, k: int) -> DataFrame:
    """``node_id, community``: blocks as equal as possible, the first ones taking the remainder."""
    size, rest = divmod(n, k)
    node, edge = F.col("id"), rest * (size + 1)
    block = F.when(node < edge, F.floor(node / (size + 1))).otherwise(F.lit(rest) + F.floor((node - edge) / max(size, 1)))
    return spark.range(n).select(node.alias("node_id"), block.cast("int").alias("community"))


def pair_pools(nodes: DataFrame) -> DataFrame:
    """``source < target, same``: all node pairs and whether they share a community. For synthetic node sets only.

    ``nodes`` holds 0..n-1. Each node makes its own row of pairs, so nothing is sorted or gathered.
    """
    n = nodes.count()
    pairs = nodes.select(F.col("node_id").alias("source"), F.col("community").alias("a"), F.explode(F.sequence(F.col("node_id") + 1, F.lit(n))).alias("target")).where(F.col("target") < n)
    other = nodes.select(F.col("node_id").alias("target"), F.col("community").alias("b"))
    return pairs.join(other, "target").select("source", "target", (F.col("a") == F.col("b")).alias("same"))


def allocation(total: int, share: float) -> tuple[int, int]:
    """Counts inside and outside, the first rounded half to even."""
    inside = round(total * share)
    return inside, total - inside


def exact_layer(pools: DataFrame, total: int, inside_share: float, seed: int | str, exclude: DataFrame | None = None) -> DataFrame:
    """``source, target, same``: exactly so many pairs inside and outside, the first ones of a hashed order.

    A smaller number takes a prefix of the same order, so the layers of rising levels are nested.
    """
    free = pools if exclude is None else pools.join(exclude, ["source", "target"], "left_anti")
    inside, outside = allocation(total, inside_share)
    keyed = free.withColumn("__key", hash_key(seed, "source", "target"))
    parts = []
    for same, count in ((True, inside), (False, outside)):
        own = stored(keyed.where(F.col("same") == same).orderBy("__key", "source", "target").limit(count).drop("__key"))
        if (got := own.count()) < count:
            raise ValueError(f"only {got} of {count} pairs are free")
        parts.append(own)
    return parts[0].unionByName(parts[1])


def bernoulli_layer(pools: DataFrame, p_in: float, p_out: float, seed: int | str, exclude: DataFrame | None = None) -> DataFrame:
    """``source, target, same``: each pair with its probability; higher probabilities keep the edges of lower ones."""
    free = pools if exclude is None else pools.join(exclude, ["source", "target"], "left_anti")
    p = F.when(F.col("same"), F.lit(p_in)).otherwise(F.lit(p_out))
    return free.where(hash_uniform(seed, "source", "target") < p)


def within_probability(n: int, k: int, expected: float, p_out: float) -> float:
    """The probability inside communities that keeps the expected number of edges at a given one outside."""
    size, rest = divmod(n, k)
    inside = rest * math.comb(size + 1, 2) + (k - rest) * math.comb(size, 2)
    p_in = (expected - p_out * (math.comb(n, 2) - inside)) / inside
    if not 0 <= p_in <= 1:
        raise ValueError("no probability keeps the expected number of edges")
    return p_in


def negative_probabilities(available_intra: int, available_inter: int, expected: float, inter_fraction: float) -> tuple[float, float]:
    """Probabilities inside and between communities for an expected number of negatives and their share between."""
    q_in, q_out = expected * (1 - inter_fraction) / available_intra, expected * inter_fraction / available_inter
    if max(q_in, q_out) > 1:
        raise ValueError("too few pairs are available")
    return q_in, q_out


def inter_community_edges(edges: DataFrame, nodes: DataFrame, sign: int = -1) -> DataFrame:
    """One row ``n_edges, n_between``: the edges of that sign, and those among them between two communities.

    ``nodes`` has ``node_id, community``; an edge with an end of no community counts as one between none.
    """
    one = nodes.select(F.col("node_id").alias("source"), F.col("community").alias("a"))
    two = nodes.select(F.col("node_id").alias("target"), F.col("community").alias("b"))
    placed = edges.where(F.signum("sign") == sign).join(one, "source", "left").join(two, "target", "left")
    return placed.agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("a") != F.col("b")).alias("n_between"))


def unsigned_panel(spark: SparkSession, n: int, k: int, expected: float, p_outs: list[float], seed: int = 0, attempts: int = 20) -> DataFrame:
    """``level, source, target, sign`` of stochastic block models with one expected number of edges.

    Each level has its probability between communities; that inside follows from the expected number. Levels
    share the uniform number of a pair. If a level is not connected all are drawn anew with the next attempt.
    """
    pools = stored(pair_pools(balanced_communities(spark, n, k)))
    for attempt in range(attempts):
        levels = []
        for level, p_out in enumerate(p_outs):
            layer = stored(bernoulli_layer(pools, within_probability(n, k, expected, p_out), p_out, f"{seed}|{attempt}|positive"))
            if not is_connected(layer, n):
                break
            levels.append(layer.select(F.lit(level).alias("level"), "source", "target", F.lit(1).alias("sign")))
        if len(levels) == len(p_outs):
            return functools.reduce(DataFrame.unionByName, levels)
    raise ValueError("no attempt gave connected layers")


def signed_panel(positive: DataFrame, pools: DataFrame, expected: float, fractions: list[float], seed: int = 0) -> DataFrame:
    """``level, source, target, sign``: negatives drawn among the free pairs of fixed positives (source, target).

    Each level has its share of negatives between communities at one expected number of them. Levels share the
    uniform number of a pair.
    """
    taken = positive.select("source", "target")
    free = stored(pools.join(taken, ["source", "target"], "left_anti"))
    intra, inter = free.agg(F.count_if("same"), F.count_if(~F.col("same"))).first()
    out = []
    for level, fraction in enumerate(fractions):
        q_in, q_out = negative_probabilities(intra, inter, expected, fraction)
        negative = bernoulli_layer(free, q_in, q_out, f"{seed}|negative").select("source", "target", F.lit(-1).alias("sign"))
        out.append(taken.withColumn("sign", F.lit(1)).unionByName(negative).select(F.lit(level).alias("level"), "source", "target", "sign"))
    return functools.reduce(DataFrame.unionByName, out)


def signed_edges(positive: DataFrame, negative: DataFrame, seed: int | str) -> DataFrame:
    """``event_id, source, target, sign, weight`` of two disjoint layers, directions and order hashed."""
    if not positive.join(negative, ["source", "target"], "left_semi").isEmpty():
        raise ValueError("the layers share a pair")
    rows = positive.select("source", "target", F.lit(1).alias("sign")).unionByName(negative.select("source", "target", F.lit(-1).alias("sign")))
    flip = hash_uniform(f"{seed}|way", "source", "target") < 0.5
    from .ranking import global_rank

    keyed = rows.withColumn("__key", hash_key(f"{seed}|order", "source", "target"))
    ordered = global_rank(keyed, ["__key", "source", "target"], "event_id")
    return ordered.select("event_id", F.when(flip, F.col("target")).otherwise(F.col("source")).alias("source"), F.when(flip, F.col("source")).otherwise(F.col("target")).alias("target"), "sign", F.col("sign").cast("double").alias("weight"))


def structural_panel(spark: SparkSession, n: int, k: int, n_positive: int, n_negative: int, intra_levels: list[float], inter_levels: list[float], seed: int = 0, attempts: int = 20) -> DataFrame:
    """``level, source, target, sign`` for coupled levels of positive intra and negative inter shares.

    All levels take prefixes of the same hashed orders. If a positive layer is not connected the next seed is tried.
    """
    nodes = balanced_communities(spark, n, k)
    pools = stored(pair_pools(nodes))
    for attempt in range(attempts):
        levels, fine = [], True
        for level, (intra, inter) in enumerate(zip(intra_levels, inter_levels)):
            positive = stored(exact_layer(pools, n_positive, intra, f"{seed}|{attempt}|positive"))
            if not is_connected(positive, n):
                fine = False
                break
            negative = exact_layer(pools, n_negative, 1 - inter, f"{seed}|{attempt}|negative", positive.select("source", "target"))
            rows = positive.select("source", "target", F.lit(1).alias("sign")).unionByName(negative.select("source", "target", F.lit(-1).alias("sign")))
            levels.append(rows.select(F.lit(level).alias("level"), "source", "target", "sign"))
        if fine:
            out = levels[0]
            for part in levels[1:]:
                out = out.unionByName(part)
            return out
    raise RuntimeError("no connected graph was found")


def prevalence_panel(positive: DataFrame, pools: DataFrame, shares: list[float], inter_fraction: float, seed: int = 0) -> DataFrame:
    """``level, source, target, sign, weight``: one positive layer with nested negatives of rising share of all edges."""
    n_positive = positive.count()
    out = None
    for level, share in enumerate(shares):
        count = round(n_positive * share / (1 - share))
        negative = exact_layer(pools, count, 1 - inter_fraction, f"{seed}|prevalence", positive.select("source", "target"))
        rows = positive.select("source", "target", F.lit(1).alias("sign")).unionByName(negative.select("source", "target", F.lit(-1).alias("sign")))
        own = rows.select(F.lit(level).alias("level"), "source", "target", "sign", F.lit(1.0).alias("weight"))
        out = own if out is None else out.unionByName(own)
    return out


def held_out(train: DataFrame, pools: DataFrame, count: int, negative_fraction: float, seed: int) -> DataFrame:
    """``source, target, sign`` of pairs outside the training graph, a fixed share of them negative."""
    taken = train.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).distinct()
    free = pools.join(taken, ["source", "target"], "left_anti").withColumn("__key", hash_key(seed, "source", "target"))
    first = free.orderBy("__key", "source", "target").limit(count)
    rank = F.row_number().over(Window.orderBy("__key", "source", "target"))  # at most count rows
    negatives = round(count * negative_fraction)
    return first.select("source", "target", F.when(rank <= negatives, -1).otherwise(1).alias("sign"))


# ---------------------------------------------------------------------------------- opinions
def opinions(nodes: DataFrame, distribution: str, seed: int, exponent: float = 2.5, mean: float = 0.5, deviation: float = 0.2) -> DataFrame:
    """``node_id, opinion``: uniform, power_law, aligned or reflected_normal opinions in [-1, 1]."""
    u, v = hash_uniform(f"{seed}|u", "node_id"), hash_uniform(f"{seed}|v", "node_id")
    side = F.when(v < 0.5, -1.0).otherwise(1.0)
    tiny = F.greatest(u, F.lit(1e-12))
    normal = F.sqrt(-2 * F.log(tiny)) * F.cos(2 * math.pi * v)

    def reflected(x: Column) -> Column:
        folded = F.pmod(x + 1, F.lit(4.0))
        return F.when(folded > 2, 4 - folded).otherwise(folded) - 1

    value = {
        "uniform": 2 * u - 1,
        "power_law": side * F.least(F.pow(tiny, F.lit(-1.0 / (exponent - 1))) - 1, F.lit(1.0)),
        "aligned": side * (0.5 + u / 2),
        "reflected_normal": reflected(side * mean + deviation * normal),
    }[distribution]
    return nodes.select("node_id", value.alias("opinion"))


def permuted_opinions(values: DataFrame, seed: int) -> DataFrame:
    """The same opinions dealt to the nodes in a hashed order, the same for every level."""
    from .ranking import global_rank

    given = global_rank(values.select("opinion", "node_id"), ["opinion", "node_id"], "rank").select("rank", "opinion")
    order = global_rank(values.select("node_id").withColumn("__key", hash_key(50_000 + seed, "node_id")), ["__key", "node_id"], "rank").select("rank", "node_id")
    return order.join(given, "rank").select("node_id", "opinion")


def layout(nodes: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``node_id, community, layout_x, layout_y``: communities around a ring, nodes scattered about their centre."""
    angle = 2 * math.pi * F.col("community") / k
    turn, far = 2 * math.pi * hash_uniform(f"{seed}|turn", "node_id"), 0.25 * F.sqrt(hash_uniform(f"{seed}|far", "node_id"))
    return nodes.select("node_id", "community", (F.cos(angle) + far * F.cos(turn)).alias("layout_x"), (F.sin(angle) + far * F.sin(turn)).alias("layout_y"))


# ---------------------------------------------------------------------------------- checks and reports
def check_panel(panel: DataFrame, n: int, same_positive: bool = False) -> None:
    """Raise unless every level is connected with disjoint layers and, if asked, one positive layer throughout."""
    for level in [r["level"] for r in panel.select("level").distinct().orderBy("level").collect()]:
        own = panel.where(F.col("level") == level)
        pairs, distinct = own.agg(F.count(F.lit(1)), F.countDistinct(F.least("source", "target"), F.greatest("source", "target"))).first()
        if pairs != distinct:
            raise ValueError(f"the layers of level {level} share a pair")
        if not is_connected(own.where("sign > 0"), n):
            raise ValueError(f"the positive layer of level {level} is not connected")
    if same_positive:
        from .events import fingerprint

        seen = {fingerprint(panel.where((F.col("level") == lv) & (F.col("sign") > 0))).first()["fingerprint"] for lv in [r[0] for r in panel.select("level").distinct().collect()]}
        if len(seen) > 1:
            raise ValueError("the positive layer changes between levels")


def baseline_report(panel: DataFrame, sets: dict[str, DataFrame], n: int) -> DataFrame:
    """``level, opinion_set, er_polarization`` of every level with every set of opinions."""
    from .polarization import er_baseline

    rows = []
    for level in [r["level"] for r in panel.select("level").distinct().orderBy("level").collect()]:
        own = stored(panel.where(F.col("level") == level))
        rows += [(level, name, er_baseline(own, values, n)) for name, values in sets.items()]
    return panel.sparkSession.createDataFrame(rows, "level int, opinion_set string, er_polarization double")


def remeasured(panel: DataFrame, coordinates: DataFrame, n: int, eta: float) -> DataFrame:
    """``level, structural_energy, antagonistic_energy, polarization`` of every level at another negative conductance."""
    from .polarization import energy_components

    rows = []
    for level in [r["level"] for r in panel.select("level").distinct().orderBy("level").collect()]:
        record = energy_components(stored(panel.where(F.col("level") == level)), coordinates, n, eta=eta)
        rows.append((level, record["structural_energy"], record["antagonistic_energy"], record["polarization"]))
    return panel.sparkSession.createDataFrame(rows, "level int, structural_energy double, antagonistic_energy double, polarization double")


def near_level(level: Column | str, value: float) -> Column:
    """Levels are compared within 1e-12."""
    return F.abs((F.col(level) if isinstance(level, str) else level) - F.lit(value)) < 1e-12


def resolve_path(path: str, data_root: str, exists) -> str:
    """A recorded path found again after the data have moved: below the data root, as it is, or absolute."""
    name = data_root.rstrip("/").rsplit("/", 1)[-1]
    tail = path.split(f"{name}/", 1)[-1] if f"{name}/" in path else path
    for option in (f"{data_root.rstrip('/')}/{tail}", path):
        if exists(option):
            return option
    raise FileNotFoundError(path)
