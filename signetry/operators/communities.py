"""Signed communities: modularity and moves as joins, Louvain in two forms, and the number of communities.

The graph has a positive and a negative layer. Modularity rewards positive and punishes negative weight inside
communities. Up to ``LOCAL_EDGES`` edges one worker per seed runs the sequential method; larger graphs take
synchronous sweeps of joins, in which the nodes of one hash parity move at a time so that neighbours do not swap.
"""

from __future__ import annotations

import gc
import math
import random
from collections import defaultdict
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored
from .events import message_edges

LOCAL_EDGES = 3_000_000
SWEEP_EDGES = 20_000_000  # up to which one worker does synchronous sweeps, beyond it joins do
HUB = 64  # enemies from which on a node's enemies' communities are counted as they change
PASSES = 10
EPSILON = 1e-7
LAYERS = {"positive": 1.0, "negative": -1.0}


def layered(edges: DataFrame) -> DataFrame:
    """``source, target, layer, weight`` with positive weights in both layers; ``weight`` is 1 where there is none."""
    weight = F.abs("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    layer = F.when(F.col("sign") > 0, "positive").otherwise("negative")
    return edges.where("sign <> 0").select("source", "target", layer.alias("layer"), weight.alias("weight"))


def _omega():
    return F.when(F.col("layer") == "positive", F.lit(LAYERS["positive"])).otherwise(F.lit(LAYERS["negative"]))


def layer_degrees(layers: DataFrame) -> DataFrame:
    """``node_id, layer, degree``; a loop counts twice."""
    doubled = message_edges(layers)
    return doubled.groupBy(F.col("source").alias("node_id"), "layer").agg(F.sum("weight").alias("degree"))


def community_layers(layers: DataFrame, partition: DataFrame) -> DataFrame:
    """``community, layer, degree, internal`` of a partition (node_id, community); internal counts each edge once."""
    degrees = layer_degrees(layers).join(partition, "node_id").groupBy("community", "layer").agg(F.sum("degree").alias("degree"))
    s = partition.select(F.col("node_id").alias("source"), F.col("community").alias("cs"))
    t = partition.select(F.col("node_id").alias("target"), F.col("community").alias("ct"))
    inside = layers.join(s, "source").join(t, "target").where("cs = ct").groupBy(F.col("cs").alias("community"), "layer").agg(F.sum("weight").alias("internal"))
    return degrees.join(inside, ["community", "layer"], "left").withColumn("internal", F.coalesce("internal", F.lit(0.0)))


def modularity(layers: DataFrame, partition: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row ``modularity``: sum over layers and communities of omega (gamma I / m - (D / 2m)^2).

    A layer without edges contributes nothing; a graph without edges has modularity 0.
    """
    by = community_layers(layers, partition)
    totals = layers.groupBy("layer").agg(F.sum("weight").alias("m"))
    each = by.join(F.broadcast(totals), "layer").select((_omega() * (resolution * F.col("internal") / F.col("m") - (F.col("degree") / (2 * F.col("m"))) ** 2)).alias("q"))
    return each.agg(F.coalesce(F.sum("q"), F.lit(0.0)).alias("modularity"))


def candidate_communities(edges: DataFrame, partition: DataFrame, hops: int = 2) -> DataFrame:
    """``node_id, community``: a node's own community and those of its neighbours and of its enemies' enemies.

    The communities of a node's enemies are made distinct before they go on to its other enemies, so that a node
    with many enemies costs their number times that of their communities, not its square.
    """
    other = partition.select(F.col("node_id").alias("target"), "community")
    both = message_edges(edges.select("source", "target", "sign"))
    near = both.join(other, "target").select(F.col("source").alias("node_id"), "community", "sign").distinct()
    enemies = both.where("sign < 0").select("source", "target").distinct()
    out, reach = near.select("node_id", "community"), near.where("sign < 0").select("node_id", "community")
    for _ in range(hops - 1):
        reach = enemies.join(reach.withColumnRenamed("node_id", "target"), "target").select(F.col("source").alias("node_id"), "community").distinct()
        out = out.unionByName(reach)
    return out.unionByName(partition.select("node_id", "community")).distinct()


def move_gains(edges: DataFrame, partition: DataFrame, resolution: float = 1.0, hops: int = 2) -> DataFrame:
    """``node_id, community, gain`` of moving each node into each of its candidate communities.

    Staying is a move out and back, whose gain is 0. The gain is not divided by the weight of the layer.
    """
    layers = layered(edges)
    degrees = layer_degrees(layers)
    totals = layers.groupBy("layer").agg(F.sum("weight").alias("m"))
    pool = degrees.join(partition, "node_id").groupBy("community", "layer").agg(F.sum("degree").alias("total"))
    other = partition.select(F.col("node_id").alias("target"), "community")
    links = message_edges(layers).where("source <> target").join(other, "target").groupBy(F.col("source").alias("node_id"), "community", "layer").agg(F.sum("weight").alias("w"))
    own = partition.select("node_id", F.col("community").alias("home"))
    wanted = candidate_communities(edges, partition, hops).join(own, "node_id").join(degrees, "node_id").join(F.broadcast(totals), "layer")
    there = wanted.join(pool, ["community", "layer"], "left").join(links, ["node_id", "community", "layer"], "left")
    home = pool.select(F.col("community").alias("home"), "layer", F.col("total").alias("home_total"))
    back = links.select("node_id", F.col("community").alias("home"), "layer", F.col("w").alias("home_w"))
    all_ = there.join(home, ["home", "layer"]).join(back, ["node_id", "home", "layer"], "left")
    d, m2 = F.col("degree"), 2 * F.col("m")
    total = F.coalesce("total", F.lit(0.0)) - F.when(F.col("community") == F.col("home"), d).otherwise(0.0)
    enter = F.coalesce("w", F.lit(0.0)) - resolution * total * d / m2
    leave = resolution * (F.col("home_total") - d) * d / m2 - F.coalesce("home_w", F.lit(0.0))
    return all_.groupBy("node_id", "community").agg(F.sum(_omega() * (enter + leave)).alias("gain"))


def induced_graph(layers: DataFrame, partition: DataFrame) -> DataFrame:
    """The graph of communities: weights per layer added up, those inside a community as loops."""
    s = partition.select(F.col("node_id").alias("source"), F.col("community").alias("cs"))
    t = partition.select(F.col("node_id").alias("target"), F.col("community").alias("ct"))
    ends = layers.join(s, "source").join(t, "target")
    return ends.groupBy(F.least("cs", "ct").alias("source"), F.greatest("cs", "ct").alias("target"), "layer").agg(F.sum("weight").alias("weight"))


def flatten(levels: list[DataFrame]) -> DataFrame:
    """``node_id, community`` of the last of the levels (node_id, community), each over the communities before."""
    out = levels[0]
    for level in levels[1:]:
        out = out.join(level.select(F.col("node_id").alias("community"), F.col("community").alias("__next")), "community").select("node_id", F.col("__next").alias("community"))
    return out


def renumbered(partition: DataFrame) -> DataFrame:
    """The same partition with communities 0..c-1 in the order of their labels."""
    from .ranking import global_rank

    labels = global_rank(partition.select(F.col("community").alias("__old")).distinct(), ["__old"], "__new")
    return partition.join(labels, partition["community"] == labels["__old"]).select("node_id", F.col("__new").alias("community"))


# ---------------------------------------------------------------------------------- synchronous sweeps
def sweep_communities(edges: DataFrame, nodes: DataFrame, sweeps: int = PASSES, hops: int = 2, epsilon: float = EPSILON, seed: int = 0) -> DataFrame:
    """``node_id, community`` after synchronous sweeps from singletons: one worker with arrays, or joins beyond SWEEP_EDGES."""
    if hops == 2 and edges.limit(SWEEP_EDGES + 1).count() <= SWEEP_EDGES:
        return stored(_worker_sweeps(edges, nodes, sweeps, epsilon, seed))
    layers = stored(layered(edges))
    partition = stored(nodes.select("node_id", F.col("node_id").alias("community")))
    quality = modularity(layers, partition).first()[0]
    for sweep in range(sweeps):
        moving = _parity(sweep // 2, seed) == sweep % 2
        gains = move_gains(edges, partition, hops=hops).where(F.round("gain", 9) > 0).where(moving)
        best = gains.groupBy("node_id").agg(F.max(F.struct(F.round("gain", 9).alias("g"), (-F.col("community")).alias("c"))).alias("b"))
        moves = best.select("node_id", (-F.col("b.c")).alias("to"))
        following = stored(partition.join(moves, "node_id", "left").select("node_id", F.coalesce("to", "community").alias("community")))
        after = modularity(layers, following).first()[0]
        if sweep % 2 and after - quality < epsilon:
            break
        quality = max(quality, after)
        discard(partition)
        partition = following
    return partition


def _parity(turn: int, seed: int):
    return F.pmod(F.xxhash64("node_id", F.lit(turn + 1000 * seed)), F.lit(2))


def _worker_sweeps(edges: DataFrame, nodes: DataFrame, sweeps: int, epsilon: float, seed: int) -> DataFrame:
    turns = range(-(-sweeps // 2))
    one = F.lit(0).alias("one")
    rows = layered(edges).select(one, "source", "target", (F.col("layer") == "positive").alias("friend"), "weight")
    ids = nodes.select(one, "node_id", *[_parity(k, seed).cast("tinyint").alias(f"turn{k}") for k in turns])

    def run(rows: pa.Table, ids: pa.Table) -> pa.Table:
        names = ids["node_id"].to_numpy()
        order = np.argsort(names)
        names = names[order]
        source, target = (np.searchsorted(names, rows[k].to_numpy()) for k in ("source", "target"))
        swept = _Swept(len(names), source, target, rows["friend"].to_numpy(), rows["weight"].to_numpy())
        home = swept.run([ids[f"turn{k}"].to_numpy()[order] for k in turns], sweeps, epsilon)
        parts = [pa.table({"node_id": names[a : a + 65_536].astype(np.int64), "community": names[home[a : a + 65_536]].astype(np.int64)}) for a in range(0, max(len(names), 1), 65_536)]
        return pa.concat_tables(parts)

    return rows.groupBy("one").cogroup(ids.groupBy("one")).applyInArrow(run, "node_id bigint, community bigint")


class _Swept:
    """Synchronous sweeps over arrays with the moves that the joins give.

    Of the communities of a hub's enemies, to which a node has no link, only the best can be its choice. Their gains
    depend on two sums alone, so equal sums are looked at once, in falling order until one is neither linked nor home.
    """

    def __init__(self, n: int, source: np.ndarray, target: np.ndarray, friend: np.ndarray, weight: np.ndarray) -> None:
        self.n, self.source, self.target, self.friend, self.weight = n, source, target, friend, weight
        u, v = np.concatenate([source, target]), np.concatenate([target, source])
        kind, w = np.concatenate([friend, friend]), np.concatenate([weight, weight])
        self.degrees = [np.bincount(u[own], w[own], n) for own in (kind, ~kind)]
        self.twice = [2 * m if (m := float(weight[own].sum())) else 1.0 for own in (friend, ~friend)]
        apart = u != v
        self.u, self.v, self.kind, self.w = u[apart], v[apart], kind[apart], w[apart]
        foes = np.unique(u[~kind].astype(np.int64) * n + v[~kind])
        self.foe = foes % n
        self.foes = np.append(0, np.cumsum(np.bincount(foes // n, minlength=n)))

    def quality(self, home: np.ndarray) -> float:
        out, inside = 0.0, home[self.source] == home[self.target]
        for own, degree, twice, omega in zip((self.friend, ~self.friend), self.degrees, self.twice, LAYERS.values()):
            out += omega * (2 * self.weight[own & inside].sum() / twice - ((np.bincount(home, degree, self.n) / twice) ** 2).sum())
        return float(out)

    def run(self, turns: list[np.ndarray], sweeps: int, epsilon: float) -> np.ndarray:
        home = np.arange(self.n)
        quality = self.quality(home)
        for sweep in range(sweeps):
            following = self.moved(home, turns[sweep // 2] == sweep % 2)
            after = self.quality(following)
            if sweep % 2 and after - quality < epsilon:
                break
            quality, home = max(quality, after), following
        return home

    def moved(self, home: np.ndarray, moving: np.ndarray) -> np.ndarray:
        n, (dp, dn), (p2, n2) = self.n, self.degrees, self.twice
        pool, debt = (np.bincount(home, d, n) for d in self.degrees)
        own = moving[self.u]
        keys = self.u[own].astype(np.int64) * n + home[self.v[own]]
        order = np.argsort(keys, kind="stable")
        keys, kind, w = keys[order], self.kind[own][order], self.w[own][order]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        linked = keys[starts]
        kindness, cruelty = (np.add.reduceat(np.where(k, w, 0.0), starts) if len(keys) else np.zeros(0) for k in (kind, ~kind))
        i, c = linked // n, linked % n
        at_home = c == home[i]
        leave = (pool[home] - dp) * dp / p2 - (debt[home] - dn) * dn / n2
        leave[i[at_home]] -= kindness[at_home] - cruelty[at_home]
        away = ~at_home
        found = [(i[away], c[away], (kindness - pool[c] * dp[i] / p2 - cruelty + debt[c] * dn[i] / n2)[away])]
        found += [self._through_few(home, moving, linked, pool, debt), self._through_hubs(home, moving, linked, pool, debt, leave)]
        i, c, enter = (np.concatenate([part[k] for part in found]) for k in range(3))
        gain = np.round(enter + leave[i], 9)
        i, c, gain = (x[gain > 0] for x in (i, c, gain))
        order = np.lexsort((c, -gain, i))
        i, c = i[order], c[order]
        first = np.append(True, i[1:] != i[:-1]) if len(i) else np.zeros(0, bool)
        out = home.copy()
        out[i[first]] = c[first]
        return out

    def _through_few(self, home, moving, linked, pool, debt):
        """Unlinked communities of the enemies of enemies who have few: all of them."""
        n, sizes = self.n, np.diff(self.foes)
        i = np.repeat(np.arange(n), sizes)
        own = moving[i] & (sizes[self.foe] <= HUB)
        i, j = i[own], self.foe[own]
        each = sizes[j]
        place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(self.foes[j], each)
        keys = np.unique(np.repeat(i, each) * n + home[self.foe[place]])
        i, c = keys // n, keys % n
        at = np.searchsorted(linked, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(linked)
        known[inside] = linked[at[inside]] == keys[inside]
        own = ~known & (c != home[i])
        i, c = i[own], c[own]
        return i, c, debt[c] * self.degrees[1][i] / self.twice[1] - pool[c] * self.degrees[0][i] / self.twice[0]

    def _through_hubs(self, home, moving, linked, pool, debt, leave):
        """Of the unlinked communities of a hub's enemies the best one for each of them, the smallest of equal ones."""
        n, (dp, dn), (p2, n2) = self.n, self.degrees, self.twice
        out: list[tuple[int, int, float]] = []
        for j in np.flatnonzero(np.diff(self.foes) > HUB):
            foes = self.foe[self.foes[j] : self.foes[j + 1]]
            all_ = np.unique(home[foes])
            all_ = all_[np.lexsort((all_, debt[all_], pool[all_]))]
            a, b = pool[all_], debt[all_]
            starts = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            ends = np.append(starts[1:], len(all_)).tolist()
            a, b, starts, all_ = a[starts], b[starts], starts.tolist(), all_.tolist()
            members = foes[moving[foes]]
            members = members[np.lexsort((dn[members], dp[members]))]
            low, high = np.searchsorted(linked, members * n).tolist(), np.searchsorted(linked, (members + 1) * n).tolist()
            last, enter, order = None, [], []
            for i, lo, hi, p, q, stay, at in zip(members.tolist(), low, high, dp[members].tolist(), dn[members].tolist(), leave[members].tolist(), home[members].tolist()):
                if last != (p, q):
                    worth = b * q / n2 - a * p / p2
                    order = np.argsort(-worth, kind="stable")
                    enter, order, last = worth[order].tolist(), order.tolist(), (p, q)
                if round(enter[0] + stay, 9) <= 0:
                    continue
                known = set((linked[lo:hi] - i * n).tolist())
                known.add(at)
                top = None
                for value, k in zip(enter, order):
                    gain = round(value + stay, 9)
                    if gain <= 0 or top is not None and gain < top:
                        break
                    c = next((c for c in all_[starts[k] : ends[k]] if c not in known), None) if ends[k] - starts[k] > 1 else (all_[starts[k]] if all_[starts[k]] not in known else None)
                    if c is not None:
                        out.append((i, c, value))
                        top = gain
        i, c, enter = zip(*out) if out else ((), (), ())
        return np.array(i, np.int64), np.array(c, np.int64), np.array(enter, float)


def swept_louvain(edges: DataFrame, seed: int) -> tuple[DataFrame, float]:
    """Communities of signed edges by synchronous sweeps and coarsening as tables, and their modularity."""
    level = stored(edges.where("sign <> 0").select("source", "target", "sign"))
    layers = stored(layered(level))
    member = stored(level.select(F.explode(F.array("source", "target")).alias("node_id")).distinct().withColumn("community", F.col("node_id")))
    quality = modularity(layers, member).first()[0]
    while True:
        home = sweep_communities(level, member.select(F.col("community").alias("node_id")).distinct(), seed=seed)
        following = stored(flatten([member, home]))
        after = modularity(layers, following).first()[0]
        if after - quality < EPSILON:
            return renumbered(member), quality
        sign = F.when(F.col("layer") == "positive", 1).otherwise(-1).alias("sign")
        level = stored(induced_graph(layered(level), home).select("source", "target", sign, "weight"))
        discard(member)
        member, quality = following, after


# ---------------------------------------------------------------------------------- one worker per seed
class _Level:
    """Layers of one level as adjacency lists with loops counted apart."""

    def __init__(self, n: int, layers: dict[str, list[tuple[int, int, float]]]) -> None:
        self.n = n
        self.near = {name: [defaultdict(float) for _ in range(n)] for name in layers}
        self.loop = {name: [0.0] * n for name in layers}
        self.m = {}
        for name, rows in layers.items():
            for u, v, w in rows:
                if u == v:
                    self.loop[name][u] += w
                else:
                    self.near[name][u][v] += w
                    self.near[name][v][u] += w
            self.m[name] = sum(w for _, _, w in rows)
        self.flat = {name: (*np.array([r[:2] for r in rows], np.int64).reshape(-1, 2).T, np.array([r[2] for r in rows], float)) for name, rows in layers.items()}
        self.degree = {name: [sum(self.near[name][i].values()) + 2 * self.loop[name][i] for i in range(n)] for name in layers}

    def quality(self, home: list[int]) -> float:
        out, at = 0.0, np.asarray(home)
        for name, omega in LAYERS.items():
            m = self.m.get(name, 0.0)
            if not m:
                continue
            u, v, w = self.flat[name]
            total = np.bincount(at, self.degree[name])
            out += omega * float(w[at[u] == at[v]].sum() / m - ((total / (2 * m)) ** 2).sum())
        return out

    def sweep_until_still(self, rng: random.Random, hops: bool) -> list[int]:
        home = list(range(self.n))
        none: list = [{}] * self.n
        friends, foes = (self.near[name] if self.m.get(name) else none for name in LAYERS)
        degrees = [self.degree[name] if self.m.get(name) else [0.0] * self.n for name in LAYERS]
        p2, n2 = (2 * self.m[name] if self.m.get(name) else 1.0 for name in LAYERS)
        pools, held = [list(d) for d in degrees], [np.array(d, float) for d in degrees]
        (pool, debt), (held_pool, held_debt) = pools, held
        enemies = self.near.get("negative", none)
        hubs = {j: _Counted(enemies[j]) for j in range(self.n) if len(enemies[j]) > HUB} if hops else {}
        quality = self.quality(home)
        order = list(range(self.n))
        for _ in range(PASSES):
            rng.shuffle(order)
            ceiling = max(debt, default=0.0)  # no community's is greater
            for i in order:
                at, dp, dn = home[i], degrees[0][i], degrees[1][i]
                kind, cruel = {}, {}
                for own, neighbours in ((kind, friends[i]), (cruel, foes[i])):
                    for j, w in neighbours.items():
                        c = home[j]
                        own[c] = own.get(c, 0.0) + w
                pool[at] -= dp
                debt[at] -= dn
                best, chosen = (kind.get(at, 0.0) - pool[at] * dp / p2) - (cruel.get(at, 0.0) - debt[at] * dn / n2), at
                options = set(kind)
                options.update(cruel)
                if hops:
                    lists = []
                    for j in enemies[i]:
                        if j in hubs:
                            lists.append(hubs[j].communities())
                        else:
                            options.update([home[k] for k in enemies[j]])
                    if lists:  # what is below a linked one by more than rounding can't be chosen
                        floor = best
                        for c in options:
                            if c != at:
                                value = (kind.get(c, 0.0) - pool[c] * dp / p2) - (cruel.get(c, 0.0) - debt[c] * dn / n2)
                                if value - 1e-9 > floor:
                                    floor = value - 1e-9
                        if ceiling * dn / n2 <= floor:
                            lists = []
                    if lists:
                        held_pool[at], held_debt[at] = pool[at], debt[at]
                        for every in lists:
                            options.update(_worthy(every, held_debt[every] * dn / n2 - held_pool[every] * dp / p2, {at, *kind, *cruel}, floor))
                options.discard(at)
                for c in sorted(options):
                    value = (kind.get(c, 0.0) - pool[c] * dp / p2) - (cruel.get(c, 0.0) - debt[c] * dn / n2)
                    if value > best + 1e-12:
                        best, chosen = value, c
                pool[chosen] += dp
                debt[chosen] += dn
                if debt[chosen] > ceiling:
                    ceiling = debt[chosen]
                for c in {at, chosen}:
                    held_pool[c], held_debt[c] = pool[c], debt[c]
                if chosen != at:
                    home[i] = chosen
                    for j in enemies[i] if hubs else ():
                        if j in hubs:
                            hubs[j].move(at, chosen)
            after = self.quality(home)
            if after - quality < EPSILON:
                break
            quality = after
        return home


def _worthy(every: np.ndarray, worth: np.ndarray, linked: set, best: float) -> list[int]:
    """Of communities and their worth without a link those that a choice can end with: the best, of equal ones the smallest.

    Linked ones have another worth and are looked at anyway.
    """
    while True:
        top = worth.max(initial=-np.inf)
        if top <= best:
            return []
        near = np.flatnonzero(worth > top - 1e-9)
        if (worth[near] == top).all() and (first := int(every[near].min())) not in linked:
            return [first]
        own = [(c, w) for c, w in zip(every[near].tolist(), worth[near].tolist()) if c not in linked]
        if own:
            least: dict = {}
            for c, w in own:
                least[w] = min(c, least.get(w, c))
            return list(least.values())
        worth[near] = -np.inf


class _Counted:
    """The communities of a node's enemies, each once, kept as enemies move."""

    def __init__(self, members) -> None:
        self.list = np.fromiter(members, np.int64, len(members))
        self.size = len(members)
        self.count = dict.fromkeys(members, 1)
        self.place = {c: k for k, c in enumerate(members)}

    def communities(self) -> np.ndarray:
        return self.list[: self.size]

    def move(self, old: int, new: int) -> None:
        if new in self.count:
            self.count[new] += 1
        else:
            self.count[new], self.place[new] = 1, self.size
            if self.size == len(self.list):
                self.list = np.concatenate([self.list, np.zeros(len(self.list) // 2 + 1, np.int64)])
            self.list[self.size] = new
            self.size += 1
        self.count[old] -= 1
        if not self.count[old]:
            del self.count[old]
            at, last = self.place.pop(old), int(self.list[self.size - 1])
            self.size -= 1
            if last != old:
                self.list[at], self.place[last] = last, at


def local_louvain(edges: list[tuple[int, int, int]], nodes: list[int], seed: int, hops: bool = True) -> tuple[dict[int, int], float]:
    """Communities of signed edges by sequential moves and coarsening, and their modularity; no edges give singletons."""
    place = {x: i for i, x in enumerate(sorted(nodes))}
    layers = {name: [] for name in LAYERS}
    for u, v, sign in edges:
        if sign:
            layers["positive" if sign > 0 else "negative"].append((place[u], place[v], 1.0))
    member = list(range(len(place)))
    if not any(layers.values()):
        return {x: i for x, i in place.items()}, 0.0
    rng = random.Random(seed)
    level = _Level(len(place), layers)
    quality = level.quality(list(range(level.n)))
    while True:
        home = level.sweep_until_still(rng, hops)
        names = {c: k for k, c in enumerate(sorted(set(home)))}
        home = [names[c] for c in home]
        after = level.quality(home)
        if after - quality < EPSILON:
            break
        member = [home[c] for c in member]
        quality = after
        coarse = {}
        for name, rows in layers.items():
            sums = defaultdict(float)
            for u, v, w in rows:
                a, b = home[u], home[v]
                sums[min(a, b), max(a, b)] += w
            coarse[name] = [(a, b, w) for (a, b), w in sums.items()]
        layers = coarse
        level = _Level(len(names), layers)
    return {x: member[i] for x, i in place.items()}, quality


def louvain_runs(edges: DataFrame, seeds: list[int]) -> DataFrame:
    """``seed, node_id, community, modularity`` of independent runs: one worker each, beyond LOCAL_EDGES sweeps of joins."""
    spark = edges.sparkSession
    if edges.where("sign <> 0").limit(LOCAL_EDGES + 1).count() > LOCAL_EDGES:
        runs = [(s, *swept_louvain(edges, s)) for s in seeds]
        return reduce(DataFrame.unionByName, [m.select(F.lit(s).alias("seed"), "node_id", "community", F.lit(q).alias("modularity")) for s, m, q in runs])
    got = edges.where("sign <> 0").select("source", "target", "sign").orderBy("source", "target").toArrow()
    rows = [got[k].to_numpy() for k in got.column_names]
    del got

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        seed = int(frame["seed"].iloc[0])
        gc.disable()  # nothing here is cyclic, and passes over millions of objects take long
        try:
            member, quality = local_louvain(list(zip(*(x.tolist() for x in rows))), np.unique(np.concatenate(rows[:2])).tolist(), seed)
        finally:
            gc.enable()
        return pd.DataFrame({"seed": seed, "node_id": list(member), "community": list(member.values()), "modularity": quality})

    return spark.createDataFrame([(s,) for s in seeds], "seed int").groupBy("seed").applyInPandas(run, "seed int, node_id bigint, community bigint, modularity double")


def mode_first(counts: DataFrame, value: str = "n", at: str = "position") -> DataFrame:
    """One row with the most frequent value, of equally frequent ones that which occurs first."""
    grouped = counts.groupBy(value).agg(F.count(F.lit(1)).alias("times"), F.min(at).alias("first"))
    return grouped.orderBy(F.desc("times"), "first").limit(1).select(value, "times")


def estimate_k(edges: DataFrame, minimum_size: int, seeds: list[int]) -> DataFrame:
    """One row ``selected_k, times``: the mode over the seeds of the number of communities of at least that size."""
    sizes = louvain_runs(edges, seeds).groupBy("seed", "community").agg(F.count(F.lit(1)).alias("size"))
    valid = sizes.groupBy("seed").agg(F.count_if(F.col("size") >= minimum_size).alias("selected_k"))
    return mode_first(valid, "selected_k", "seed")


def packed_communities(partition: DataFrame) -> DataFrame:
    """``community_id, nodes, size``: the members of each community as sorted text, for the communities file."""
    grouped = partition.groupBy(F.col("community").alias("community_id")).agg(F.array_sort(F.collect_list("node_id")).alias("n"))
    return grouped.select("community_id", F.concat_ws(",", F.transform("n", lambda x: x.cast("string"))).alias("nodes"), F.size("n").cast("bigint").alias("size"))


def resolved_k(computed: int | None, stored_k: int | None, fallback: int) -> tuple[int, str]:
    """The number of communities and where it is from: computed, metadata or fallback."""
    for value, source in ((computed, "computed"), (stored_k, "metadata"), (fallback, "fallback")):
        if value is not None and not math.isnan(value):
            return int(value), source
    raise ValueError("no number of communities is known")
