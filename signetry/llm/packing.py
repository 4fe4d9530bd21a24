"""Items packed into containers of fixed capacity by exact-complement hashing over their lengths.

All that the choice needs is how many items have each length, a table no longer than the capacity however many
items there are. A container starts with the longest length left. Sums of one, two and three lengths are
indexed; a combination that fills the gap to the last token is taken as soon as there is one, else the longest
length that fits. Each pattern is used as often as its lengths allow, so patterns are few: every one uses up a
length or more than halves its count. Items then find their place by their rank among those of their length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

RANK_BLOCK = 100_000  # items of one length ranked in one task
REFRESH = 32  # patterns between rebuilds of the index of pair sums


class LengthIndex:
    """Available lengths with an index of the sums of two of them."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts.astype(np.int64).copy()
        self.counts[0] = 0
        self.longest = len(counts) - 1
        self.rebuild()

    def rebuild(self) -> None:
        """Sums of two available lengths; sums that have gone since are found out when they are tried."""
        have = (self.counts > 0).astype(np.float64)
        size = 2 * len(have)
        spectrum = np.fft.rfft(have, size)
        self.pair_sums = np.fft.irfft(spectrum * spectrum, size)[: len(have)] > 0.5
        while self.longest and not self.counts[self.longest]:
            self.longest -= 1

    def pair(self, total: int, free: np.ndarray) -> tuple[int, int] | None:
        """Two free lengths with this sum, the longer one as long as possible."""
        low = -(-total // 2)
        high = min(total - 1, self.longest)
        if high < low:
            return None
        a = np.arange(low, high + 1)
        fits = (free[a] > 0) & (free[total - a] > 0)
        if total % 2 == 0 and low <= high and free[low] < 2:
            fits[0] = False
        hit = np.flatnonzero(fits)
        return (int(a[hit[-1]]), int(total - a[hit[-1]])) if len(hit) else None

    def exact(self, gap: int, free: np.ndarray) -> tuple[int, ...] | None:
        """One, two or three free lengths that fill the gap exactly."""
        if gap <= self.longest and free[gap] > 0:
            return (gap,)
        if gap > 3 * self.longest:
            return None
        if self.pair_sums[gap] and (found := self.pair(gap, free)):
            return found
        high = min(gap - 2, self.longest)
        if high < 1:
            return None
        a = np.arange(1, high + 1)
        for first in a[(free[a] > 0) & self.pair_sums[gap - a]][::-1]:
            free[first] -= 1
            found = self.pair(int(gap - first), free)
            free[first] += 1
            if found:
                return (int(first), *found)
        return None


def patterns(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """``({length: copies}, times)`` for all items; ``counts[l]`` items have length l, none above the capacity."""
    index = LengthIndex(np.pad(np.asarray(counts, np.int64), (0, max(0, capacity + 1 - len(counts))))[: capacity + 1])
    out = []
    while True:
        if len(out) % REFRESH == 0:
            index.rebuild()
        while index.longest and not index.counts[index.longest]:
            index.longest -= 1
        if not index.longest:
            return out
        free = index.counts.copy()
        used: dict[int, int] = {}

        def take(length: int) -> None:
            free[length] -= 1
            used[length] = used.get(length, 0) + 1

        take(index.longest)
        gap = capacity - index.longest
        while gap:
            if found := index.exact(gap, free):
                for length in found:
                    take(length)
                break
            fitting = np.flatnonzero(free[1 : gap + 1])
            if not len(fitting):
                break
            take(int(fitting[-1]) + 1)
            gap -= int(fitting[-1]) + 1
        times = min(int(index.counts[length]) // copies for length, copies in used.items())
        for length, copies in used.items():
            index.counts[length] -= copies * times
        out.append((used, times))


def _slots(plan: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, ...]:
    """Ranges of ranks per length: key, first rank, copies and first container, ordered by length and rank."""
    rows, taken, container = [], {}, 0
    for used, times in plan:
        for length, copies in used.items():
            first = taken.get(length, 0)
            rows.append((length, first, copies, container))
            taken[length] = first + copies * times
        container += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return tuple(table.T)


def ranked_by_length(items: DataFrame, counts: dict[int, int], order: list[str]) -> DataFrame:
    """``items`` with ``rank`` from 0 among those of the same ``length``, in blocks, so that no length is one task."""
    hot = [(int(length), -(-n // RANK_BLOCK)) for length, n in counts.items() if n > RANK_BLOCK]
    if hot:  # no more rows than there are lengths
        blocks = items.sparkSession.createDataFrame(hot, "length int, __blocks bigint")
        items = items.join(F.broadcast(blocks), "length", "left")
    else:
        items = items.withColumn("__blocks", F.lit(1))
    items = items.withColumn("__block", F.pmod(F.xxhash64(*order), F.coalesce("__blocks", F.lit(1))).cast("int")).drop("__blocks")
    sizes = items.groupBy("length", "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.partitionBy("length").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.row_number().over(Window.partitionBy("length", "__block").orderBy(*order)) - 1
    ranked = items.withColumn("__own", own).join(before.drop("__n"), ["length", "__block"])
    return ranked.withColumn("rank", F.col("__own") + F.coalesce("__before", F.lit(0))).drop("__own", "__before", "__block")


def pack(sizes: DataFrame, capacity: int) -> DataFrame:
    """``doc_id, part, n_tokens, container_id`` of every item of ``sizes`` (doc_id, n_tokens).

    An item longer than the capacity is split into parts of the capacity and a rest; no other item is split.
    An item without tokens needs no room: it has part 0 and a null container. Items with a null size are taken
    as without tokens. Repeated rows are items of their own. An empty table gives no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    n = F.coalesce("n_tokens", F.lit(0))
    empty = sizes.where(n <= 0).select("doc_id", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("n_tokens"), F.lit(None).cast("bigint").alias("container_id"))
    last = F.ceil(F.col("n_tokens") / capacity).cast("int") - 1
    parts = sizes.where(n > 0).select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), last)).alias("part"))
    items = parts.select("doc_id", "part", F.least(F.col("n_tokens") - F.col("part") * capacity, F.lit(capacity)).cast("int").alias("length"))
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    histogram = np.zeros(capacity + 1, np.int64)
    for length, count in counts.items():
        histogram[length] = count
    lengths, first, copies, container = _slots(patterns(histogram, capacity))
    wide = int(histogram.max()) + 1
    keys = lengths * wide + first

    @F.pandas_udf(T.LongType())
    def place(length: pd.Series, rank: pd.Series) -> pd.Series:
        at = np.searchsorted(keys, length.to_numpy(np.int64) * wide + rank.to_numpy(np.int64), "right") - 1
        return pd.Series(container[at] + (rank.to_numpy(np.int64) - first[at]) // copies[at])

    placed = ranked_by_length(items, counts, ["doc_id", "part"]).select(
        "doc_id", "part", F.col("length").cast("bigint").alias("n_tokens"), place("length", "rank").alias("container_id")
    )
    return placed.unionByName(empty)


def pack_all(sizes: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """``container_name, container_id, doc_id, part, n_tokens, capacity_tokens``: each kind of container holds all items."""
    sizes = stored(sizes)
    out = None
    for name, capacity in capacities.items():
        own = pack(sizes, capacity).select(
            F.lit(name).alias("container_name"), "container_id", "doc_id", "part", "n_tokens", F.lit(capacity).alias("capacity_tokens")
        )
        out = own if out is None else out.unionByName(own)
    return out


def fills(assignment: DataFrame) -> DataFrame:
    """``container_name, container_id, n_items, used_tokens, capacity_tokens, fill`` of every container."""
    groups = assignment.where("container_id is not null").groupBy("container_name", "container_id", "capacity_tokens")
    out = groups.agg(F.count(F.lit(1)).alias("n_items"), F.sum("n_tokens").alias("used_tokens"))
    return out.withColumn("fill", F.round(F.col("used_tokens") / F.col("capacity_tokens"), 6))
