"""One surviving record per group of duplicates, by a consensus over the tokens of their values.

Two forms share the method. ``survivors`` takes typed fields: a row is the sequence of the tokens it has, each
with a weight that is compared place by place (trust, then recency, and so on), so that a row of higher standing
can't be outvoted by many of lower standing. ``consensus`` takes texts of tokens whose weights add up. In both,
values of a group are aligned progressively, heaviest first, in blocks of bounded size whose profiles are aligned
with each other again, each column elects its heaviest token, and what survives is an existing value: of a typed
field the elected token itself, of a text the one with the smallest token edit distance to the elected sequence.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

BLOCK = 64  # values aligned, or profiles merged, in one step
GAP = ""
PENALTY = -0.4  # of a gap, a full match counting 1
ALIKE = 0.5  # different tokens of one kind
UNLIKE = -2.0  # tokens of different kinds, worse than two gaps
CHUNK = 2000


@dataclass(frozen=True)
class Vote:
    """A field of one token: rows where ``counts`` holds vote for ``value`` with ``weight``, most significant first.

    ``value`` is of any orderable type but an array, map or struct, the places of ``weight`` are whole numbers or timestamps.
    Nulls in a weight are lightest. The value itself breaks remaining ties, the greatest wins.
    """

    name: str
    value: Column
    counts: Column
    weight: tuple[Column, ...] = field(default_factory=tuple)


def survivors(rows: DataFrame, keys: list[str], votes: list[Vote], at_least: int = 1) -> DataFrame:
    """One row per group of at least ``at_least`` rows: the keys, ``n_rows`` and the elected token of each field.

    A field nobody votes for is null. Rows with a null key form groups like any other. Repeated rows count as
    rows. A group of more than BLOCK rows is cut into blocks by a hash of the row, whose profiles are aligned with
    each other in rounds, so no task holds more than about BLOCK rows of a group. An empty table gives no rows.
    """
    kinds = range(len(votes))
    tokens = [F.when(v.counts, v.value).alias(f"t{k}") for k, v in enumerate(votes)]
    places: dict[str, Column] = {}
    for w in (w for v in votes for w in v.weight):
        places.setdefault(str(w), w.alias(f"w{len(places)}"))
    at = {name: i for i, name in enumerate(places)}
    layout = [[k, *[len(votes) + at[str(w)] for w in v.weight]] for k, v in enumerate(votes)]
    base = rows.select(*keys, F.struct(*tokens, *places.values()).alias("__row"))
    own = base.schema["__row"].dataType
    heavy = [T.StructField(f"w{k}_{i}", own.fields[at].dataType) for k in kinds for i, at in enumerate(layout[k][1:])]
    merged = T.StructType([T.StructField(f"t{k}", own.fields[k].dataType) for k in kinds] + heavy)
    again = [[k, *[merged.fieldNames().index(f"w{k}_{i}") for i in range(len(layout[k]) - 1)]] for k in kinds]

    def elected_of(groups: DataFrame, names: list[str], by: list[list[int]], least: int) -> DataFrame:
        """Groups of ``__row`` aligned, with the number of rows behind them in ``__n``."""
        items = groups.groupBy(*names).agg(F.collect_list("__row").alias("__rows"), F.sum("__n").alias("__n")).where(F.col("__n") >= least)
        return items.select(*names, "__n", _aligned_rows(by, merged)(F.col("__rows")).alias("__row"))

    counted = base.withColumn("__n", F.lit(1).cast("bigint"))
    sizes = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size")).where(F.col("__size") > BLOCK)
    hot = stored(sizes.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "__size"))
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    most = hot.agg(F.max("__size")).first()[0] or 0
    if not most:
        best = elected_of(counted, keys, layout, at_least)
    else:
        best = elected_of(counted.join(hot, same, "left_anti"), keys, layout, at_least)
        block = F.pmod(F.xxhash64("__row"), F.ceil(F.col("__size") * 2 / BLOCK)).alias("__block")
        parts = elected_of(counted.join(hot, same).select(*keys, block, "__row", "__n"), [*keys, "__block"], layout, 1)
        width = -(-2 * most // BLOCK)
        while width > 1:
            parts = stored(parts.withColumn("__block", F.floor(F.col("__block") / BLOCK)))
            parts = elected_of(parts, [*keys, "__block"], again, 1)
            width = -(-width // BLOCK)
        best = best.unionByName(parts.where(F.col("__n") >= at_least).drop("__block"))
    return best.select(*keys, F.col("__n").alias("n_rows"), *[F.col(f"__row.t{k}").alias(v.name) for k, v in enumerate(votes)])


def _ranks(columns: list[np.ndarray]) -> np.ndarray:
    """Dense ranks of rows by their columns, the first most significant."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    order = np.lexsort(columns[::-1])
    changed = np.zeros(len(order), bool)
    for c in columns:
        changed[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(changed)
    return out


def _codes(tokens: pa.Array) -> np.ndarray:
    """Whole numbers in the order of the tokens, -1 for null."""
    coded = pc.dictionary_encode(tokens)
    place = np.empty(len(coded.dictionary), np.int64)
    place[pc.array_sort_indices(coded.dictionary).to_numpy()] = np.arange(len(place))
    index = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
    return np.where(index < 0, -1, place[index] if len(place) else -1)


def progressive(sizes: np.ndarray, codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Per group and kind of token the row whose token its column elects, -1 for none.

    ``sizes`` are the numbers of rows of the groups, which follow each other; ``codes, weights`` are (rows, kinds),
    a code of -1 stands for a token that is not there. Every row is the sequence of its tokens in the order of the
    kinds. All groups are aligned at once: in each step the next row of every group against the group's profile.
    """
    kinds = codes.shape[1]
    firsts = np.cumsum(sizes) - sizes
    group = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((*[-weights[:, k] for k in reversed(range(kinds))], group))  # the heaviest first
    kind, row = (np.full((len(sizes), kinds), -1, np.int64) for _ in range(2))  # the profile, a column per place
    length = np.zeros(len(sizes), np.int64)
    for step in range(int(sizes.max()) if len(sizes) else 0):
        g = np.flatnonzero(sizes > step)
        r = order[firsts[g] + step]
        has = codes[r] >= 0
        there = has.sum(1)
        s = np.argsort(~has, axis=1, kind="stable")  # kinds of the row's tokens, then those it lacks
        p, q, n = kind[g], row[g], length[g]
        code_p = np.where(p >= 0, codes[q, np.maximum(p, 0)], -2)
        code_s = np.take_along_axis(codes[r], s, 1)
        match = np.where(p[:, :, None] == s[:, None, :], np.where(code_p[:, :, None] == code_s[:, None, :], 1.0, ALIKE), UNLIKE)
        score = np.zeros((len(g), kinds + 1, kinds + 1))
        score[:, :, 0] = score[:, 0, :] = PENALTY * np.arange(kinds + 1)
        for i in range(1, kinds + 1):
            for j in range(1, kinds + 1):
                gap = np.maximum(score[:, i - 1, j], score[:, i, j - 1]) + PENALTY
                score[:, i, j] = np.maximum(gap, score[:, i - 1, j - 1] + match[:, i - 1, j - 1])
        i, j, all_ = n.copy(), there.copy(), np.arange(len(g))
        new_kind, new_row = (np.full((len(g), 2 * kinds), -1, np.int64) for _ in range(2))
        for at in range(2 * kinds - 1, -1, -1):
            pi, sj = np.maximum(i - 1, 0), np.maximum(j - 1, 0)
            pair = (i > 0) & (j > 0) & (np.abs(score[all_, i, j] - score[all_, pi, sj] - match[all_, pi, sj]) < 1e-9)
            up = (i > 0) & ((j == 0) | (np.abs(score[all_, i, j] - score[all_, pi, j] - PENALTY) < 1e-9))
            left = (j > 0) & ((i == 0) | (np.abs(score[all_, i, j] - score[all_, i, sj] - PENALTY) < 1e-9))
            up &= ~pair & (~left | (p[all_, pi] > s[all_, sj]))  # of two gaps the later kind stands behind
            left &= ~pair & ~up
            k = np.where(pair | up, p[all_, pi], s[all_, sj])
            old, own = q[all_, pi], r
            heavier = weights[own, k] > weights[np.maximum(old, 0), k]
            new_kind[:, at] = np.where(pair | up | left, k, -1)
            new_row[:, at] = np.where(pair, np.where(heavier, own, old), np.where(up, old, np.where(left, own, -1)))
            i, j = i - (pair | up), j - (pair | left)
        front = np.argsort(new_kind < 0, axis=1, kind="stable")[:, :kinds]
        kind[g], row[g] = np.take_along_axis(new_kind, front, 1), np.take_along_axis(new_row, front, 1)
        length[g] = (new_kind >= 0).sum(1)
    out = np.full((len(sizes), kinds), -1, np.int64)
    for at in range(kinds):
        g = np.flatnonzero(kind[:, at] >= 0)
        out[g, kind[g, at]] = row[g, at]
    return out


def _aligned_rows(layout: list[list[int]], out: T.StructType):
    """The consensus of each list of rows; ``layout`` has per kind the field of the token and those of its weight."""

    @F.arrow_udf(out)
    def consensus_of(lists: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        fields = lists.flatten().flatten()
        least = np.iinfo(np.int64).min
        number = lambda a: pc.fill_null(a.cast(pa.int64()), least).to_numpy(zero_copy_only=False)
        codes = np.stack([_codes(fields[t]) for t, *_ in layout], 1)
        weights = np.stack([_ranks([*[number(fields[w]) for w in ws], codes[:, k]]) for k, (_, *ws) in enumerate(layout)], 1)
        chosen = progressive(sizes, codes, weights)
        take = lambda a, rows: a.take(pa.array(np.maximum(rows, 0), mask=rows < 0))
        tokens = [take(fields[t], chosen[:, k]) for k, (t, *_) in enumerate(layout)]
        kept = [take(fields[w], chosen[:, k]) for k, (_, *ws) in enumerate(layout) for w in ws]
        return pa.StructArray.from_arrays([*tokens, *kept], names=out.fieldNames())

    return consensus_of


# ---------------------------------------------------------------------------------- values of several tokens
Profile = list[dict[str, float]]


def _matches(a: Profile, b: Profile) -> np.ndarray:
    """For every pair of columns the share of vote pairs that name the same token, scaled to -1..1."""
    where: dict[str, list[tuple[int, float]]] = {}
    for i, column in enumerate(a):
        for token, weight in column.items():
            if token != GAP:
                where.setdefault(token, []).append((i, weight))
    out = np.full((len(a), len(b)), -1.0)
    scale = 2.0 / (sum(a[0].values()) * sum(b[0].values()))
    for j, column in enumerate(b):
        for token, weight in column.items():
            for i, other in where.get(token, ()):
                out[i, j] += scale * weight * other
    return out


def _merged(a: dict[str, float], b: dict[str, float]) -> dict[str, float]:
    out = dict(a)
    for token, weight in b.items():
        out[token] = out.get(token, 0.0) + weight
    return out


def _same(a: dict[str, float], b: dict[str, float]) -> bool:
    return len(a) == len(b) == 1 and a.keys() == b.keys()


def align(a: Profile, b: Profile) -> Profile:
    """The two profiles merged along their best global alignment; equal scores prefer a match, then a gap in b.

    Columns that agree at both ends are matched first. What differs between them is cut at tokens that both have
    once, in the same order, so that an insertion moves nothing behind the next of them; only where there is none
    within CHUNK columns are stretches of that length cut off. So very long values take time in proportion to
    their length.
    """
    weight_a, weight_b = (sum(p[0].values()) if p else 0.0 for p in (a, b))
    head = 0
    while head < min(len(a), len(b)) and _same(a[head], b[head]):
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and _same(a[-1 - tail], b[-1 - tail]):
        tail += 1
    out = [_merged(x, y) for x, y in zip(a[:head], b[:head])]
    mid_a, mid_b = a[head : len(a) - tail], b[head : len(b) - tail]
    i = j = 0
    for x, y in [*_anchors(mid_a, mid_b), (len(mid_a), len(mid_b))]:
        while max(x - i, y - j) > CHUNK:  # no anchor near enough
            out += _aligned(mid_a[i : min(i + CHUNK, x)], mid_b[j : min(j + CHUNK, y)], weight_a, weight_b)
            i, j = min(i + CHUNK, x), min(j + CHUNK, y)
        out += _aligned(mid_a[i:x], mid_b[j:y], weight_a, weight_b)
        i, j = x, y
    return out + [_merged(x, y) for x, y in zip(a[len(a) - tail :], b[len(b) - tail :])]


def _anchors(a: Profile, b: Profile) -> list[tuple[int, int]]:
    """Places to cut two long profiles at, in both increasing: columns whose heaviest token is found once on each side.

    The longest increasing chain of such pairs, thinned out to what lies at least half of CHUNK apart. Short
    profiles need none.
    """
    if max(len(a), len(b)) <= CHUNK:
        return []
    leaders = [[max(sorted(c), key=lambda t: c[t]) for c in p] for p in (a, b)]
    once = [{t for t, n in Counter(side).items() if n == 1 and t != GAP} for side in leaders]
    at = {t: j for j, t in enumerate(leaders[1]) if t in once[1]}
    pairs = [(i, at[t]) for i, t in enumerate(leaders[0]) if t in once[0] and t in at]
    ends: list[int] = []
    last: list[int] = []  # index of the pair that ends the shortest chain of each length
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        n = bisect_left(ends, j)
        before[k] = last[n - 1] if n else -1
        ends[n:n + 1], last[n:n + 1] = [j], [k]
    chain = []
    k = last[-1] if last else -1
    while k >= 0:
        chain.append(pairs[k])
        k = before[k]
    out: list[tuple[int, int]] = []
    for i, j in reversed(chain):
        if i - (out[-1][0] if out else 0) >= CHUNK // 2 or j - (out[-1][1] if out else 0) >= CHUNK // 2:
            out.append((i, j))
    return out


def _aligned(a: Profile, b: Profile, weight_a: float, weight_b: float) -> Profile:
    left = lambda c: {**c, GAP: c.get(GAP, 0.0) + weight_b}
    right = lambda c: {**c, GAP: c.get(GAP, 0.0) + weight_a}
    if not a or not b:
        return [left(c) for c in a] + [right(c) for c in b]
    n, m = len(a), len(b)
    match = _matches(a, b)
    slope = PENALTY * np.arange(m + 1)
    score = np.empty((n + 1, m + 1))
    score[0] = slope
    for i in range(1, n + 1):
        best = score[i - 1] + PENALTY
        best[1:] = np.maximum(best[1:], score[i - 1, :-1] + match[i - 1])
        score[i] = slope + np.maximum.accumulate(best - slope)  # gaps in a, carried along the row
    out: Profile = []
    i, j = n, m
    near = lambda x, y: abs(x - y) < 1e-9
    while i or j:
        if i and j and near(score[i, j], score[i - 1, j - 1] + match[i - 1, j - 1]):
            i, j = i - 1, j - 1
            out.append(_merged(a[i], b[j]))
        elif i and near(score[i, j], score[i - 1, j] + PENALTY):
            i -= 1
            out.append(left(a[i]))
        else:
            j -= 1
            out.append(right(b[j]))
    return out[::-1]


def profile_of(values: list[str], weights: list[float]) -> Profile:
    """Progressive alignment of token sequences, the heaviest first, equal ones in order of their text."""
    out: Profile | None = None
    for value, weight in sorted(zip(values, weights), key=lambda x: (-x[1], x[0])):
        own = [{t: weight} for t in value.split()]
        out = own if out is None else align(out, own)
    return out or []


def elected(profile: Profile) -> list[str]:
    """The heaviest token of each column, the smallest among equals; columns won by the gap fall away."""
    best = (max(sorted(column), key=lambda t: column[t]) for column in profile)
    return [t for t in best if t != GAP]


def distance(a: list[str], b: list[str]) -> int:
    """Token edit distance."""
    head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[head:], b[head:]
    tail = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), min(len(a), len(b)))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    codes: dict[str, int] = {}
    x, y = (np.array([codes.setdefault(t, len(codes)) for t in s], np.int64) for s in (a, b))
    steps = np.arange(len(y) + 1)
    row = steps.copy()
    for i, token in enumerate(x, 1):
        best = row + 1
        best[1:] = np.minimum(best[1:], row[:-1] + (y != token))
        best[0] = i
        row = steps + np.minimum.accumulate(best - steps)
    return int(row[-1])


@F.pandas_udf(T.StringType())
def _build(values: pd.Series, weights: pd.Series) -> pd.Series:
    return pd.Series([json.dumps(profile_of(list(v), list(w))) for v, w in zip(values, weights)])


@F.pandas_udf(T.StringType())
def _merge(profiles: pd.Series) -> pd.Series:
    def merged(parts) -> str:
        columns = sorted((json.loads(p) for p in parts), key=lambda p: (-sum(p[0].values()) if p else 0.0, str(p)))
        out = columns[0]
        for p in columns[1:]:
            out = align(out, p)
        return json.dumps(out)

    return pd.Series([merged(p) for p in profiles])


@F.pandas_udf(T.StringType())
def _elect(profiles: pd.Series) -> pd.Series:
    return pd.Series([" ".join(elected(json.loads(p))) for p in profiles])


@F.pandas_udf(T.IntegerType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([distance(x.split(), y.split()) for x, y in zip(a, b)])


def consensus(rows: DataFrame, keys: list[str], value: Column, weight: Column, witness: Column) -> DataFrame:
    """``keys, n_values, consensus, value, distance, witness``: the existing value nearest to each group's consensus.

    ``value`` is text of tokens between spaces, ``weight`` a positive number, ``witness`` an id of which the
    greatest among the rows with the value is given. Equal distances go to the heavier, then the smaller value.
    Rows with a null value or weight do not vote, groups without votes are left out. A group with many distinct
    values is aligned in blocks and its profiles are merged in rounds, so no task holds more than BLOCK of them.
    """
    names = [*keys]
    pooled = (
        rows.select(*keys, value.alias("__value"), weight.cast("double").alias("__weight"), witness.alias("__witness"))
        .where(F.col("__value").isNotNull() & (F.col("__weight") > 0))
        .groupBy(*names, "__value")
        .agg(F.sum("__weight").alias("__weight"), F.max("__witness").alias("__witness"))
    )
    counts = pooled.groupBy(*names).agg(F.count(F.lit(1)).alias("n_values"), F.max("__value").alias("__only"), F.max("__witness").alias("__w"))
    counted = counts.select(*[F.col(k).alias(f"__k_{k}") for k in names], "n_values", "__only", "__w")
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in names]
    single = counts.where("n_values = 1").select(
        *names, "n_values", F.col("__only").alias("consensus"), F.col("__only").alias("value"), F.lit(0).alias("distance"), F.col("__w").alias("witness")
    )
    several = pooled.join(counted.where("n_values > 1"), same).drop(*[f"__k_{k}" for k in names], "__only", "__w")
    several = stored(several)
    most = several.agg(F.max("n_values")).first()[0] or 0
    blocks = F.pmod(F.xxhash64("__value"), F.ceil(F.col("n_values") * 2 / BLOCK)).alias("__block")
    item = F.sort_array(F.collect_list(F.struct("__value", "__weight")))
    grouped = several.groupBy(*names, blocks).agg(item.alias("__items"))
    profiles = grouped.select(*names, "__block", _build(F.col("__items.__value"), F.col("__items.__weight")).alias("__profile"))
    width = -(-2 * most // BLOCK)
    while width > 1:
        profiles = profiles.groupBy(*names, F.floor(F.col("__block") / BLOCK).alias("__block")).agg(F.collect_list("__profile").alias("__parts"))
        profiles = profiles.select(*names, "__block", F.when(F.size("__parts") == 1, F.col("__parts")[0]).otherwise(_merge("__parts")).alias("__profile"))
        width = -(-width // BLOCK)
    winner = profiles.select(*[F.col(k).alias(f"__k_{k}") for k in names], _elect("__profile").alias("consensus"))
    near = several.join(winner, same).withColumn("distance", _distance("consensus", "__value"))
    best = near.groupBy(*names).agg(
        F.max("n_values").alias("n_values"),
        F.min(F.struct("distance", (-F.col("__weight")).alias("w"), F.col("__value").alias("v"), F.col("__witness").alias("id"), "consensus")).alias("__best"),
    )
    chosen = best.select(
        *names, "n_values", F.col("__best.consensus").alias("consensus"), F.col("__best.v").alias("value"), F.col("__best.distance").alias("distance"), F.col("__best.id").alias("witness")
    )
    return single.unionByName(chosen)
