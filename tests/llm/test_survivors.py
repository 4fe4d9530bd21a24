import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from signetry.llm import survivors as s
from signetry.llm.survivors import Vote, align, consensus, distance, elected, profile_of, survivors


def test_votes_are_compared_place_by_place(spark, rows):
    df = spark.createDataFrame(
        [(1, "a", 1, 10, 0), (1, "b", 5, 1, 0), (1, "a", 1, 11, 0), (2, "x", None, None, 9), (None, "n", 1, 1, 1), (3, None, 1, 1, 1)],
        "k int, v string, trust int, at int, n_rows int",
    )
    votes = [Vote("v", F.col("v"), F.col("v").isNotNull(), (F.col("trust"), F.col("at")))]
    assert rows(survivors(df, ["k"], votes)) == [(1, 3, "b"), (2, 1, "x"), (3, 1, None), (None, 1, "n")]
    assert rows(survivors(df, ["k"], votes, at_least=2)) == [(1, 3, "b")]
    assert rows(survivors(df.limit(0), ["k"], votes)) == []


def test_ties_go_to_the_greatest_value(spark, rows):
    df = spark.createDataFrame([(1, "a"), (1, "c"), (1, "b"), (1, "c")], "k int, v string")
    assert rows(survivors(df, ["k"], [Vote("v", F.col("v"), F.lit(True))])) == [(1, 4, "c")]


def _brute(groups, codes, weights):
    out, at = [], 0
    for size in groups:
        own = range(at, at + size)
        out.append([max((i for i in own if codes[i][k] >= 0), key=lambda i: weights[i][k], default=-1) for k in range(len(codes[0]))])
        at += size
    return out


def test_progressive_alignment_elects_the_heaviest_token_of_each_kind():
    r = random.Random(8)
    for kinds in (1, 2, 3, 5):
        sizes = np.array([r.randint(1, 9) for _ in range(60)])
        n = int(sizes.sum())
        codes = np.array([[r.choice([-1, 0, 1, 2]) for _ in range(kinds)] for _ in range(n)])
        weights = np.array([[r.random() for _ in range(kinds)] for _ in range(n)])
        assert s.progressive(sizes, codes, weights).tolist() == _brute(sizes, codes, weights)
    assert s.progressive(np.zeros(0, int), np.zeros((0, 2), int), np.zeros((0, 2))).shape == (0, 2)


def test_a_hot_group_is_aligned_in_blocks(spark, rows):
    r = random.Random(4)
    data = [(1 if i % 3 else None, f"v{r.randint(0, 500)}", r.choice([None, 1, 2]), i) for i in range(9000)] + [(2, "x", 1, 1), (2, "y", 1, 2)]
    df = spark.createDataFrame(data, "k int, v string, trust int, at int")
    votes = [Vote("v", F.col("v"), F.col("at") % 7 != 0, (F.col("trust"), F.col("at"))), Vote("top", F.col("at"), F.lit(True))]
    got = rows(survivors(df, ["k"], votes))
    want = []
    for k in (1, 2, None):
        own = [x for x in data if x[0] == k]
        want.append((k, len(own), max((x for x in own if x[3] % 7), key=lambda x: (x[2] is not None, x[2] or 0, x[3]))[1], max(x[3] for x in own)))
    assert got == want


def test_alignment_elects_the_majority_column_by_column():
    values = ["the quick brown fox", "the quick fox", "the quack brown fox", "the quick brown fix"]
    assert elected(profile_of(values, [1.0] * 4)) == "the quick brown fox".split()
    assert elected(profile_of(["a b"], [1.0])) == ["a", "b"]
    assert profile_of([], []) == []
    assert elected(align([], [{"x": 1.0}])) == ["x"]


def test_a_gap_can_win():
    assert elected(profile_of(["a b c", "a c", "a c"], [1.0, 1.0, 1.0])) == ["a", "c"]


def test_distance_equals_the_plain_recurrence():
    def plain(a, b):
        t = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            t[i, j] = min(t[i - 1, j] + 1, t[i, j - 1] + 1, t[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        return t[len(a), len(b)]

    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.choice("xyz") for _ in range(r.randint(0, 7))] for _ in range(2))
        assert distance(list(a), list(b)) == plain(a, b)


def test_consensus_takes_an_existing_value(spark, rows):
    data = [(1, "a b c d", 1.0, 1), (1, "a b c d", 1.0, 7), (1, "a x c d", 1.0, 3), (1, "a b c", 1.5, 4), (2, "only", 1.0, 5), (3, None, 1.0, 6), (4, "w", None, 8), (5, "", 1.0, 9), (None, "n m", 1.0, 2), (None, "n o", 2.0, 3)]
    df = spark.createDataFrame(data, "k int, v string, w double, id int")
    out = {r["k"]: (r["n_values"], r["value"], r["distance"], r["witness"]) for r in consensus(df, ["k"], F.col("v"), F.col("w"), F.col("id")).collect()}
    assert out[1] == (3, "a b c d", 0, 7)
    assert out[2] == (1, "only", 0, 5)
    assert out[5] == (1, "", 0, 9)
    assert out[None] == (2, "n o", 0, 3)
    assert set(out) == {1, 2, 5, None}
    assert consensus(df.limit(0), ["k"], F.col("v"), F.col("w"), F.col("id")).count() == 0


def test_blocks_and_rounds_agree_with_one_block(spark, monkeypatch):
    base = "one two three four five six".split()
    r = random.Random(3)
    values = [" ".join(t if r.random() > 0.1 else f"t{i}" for t in base) for i in range(300)]
    df = spark.createDataFrame([(1, v, 1.0, i) for i, v in enumerate(values)], "k int, v string, w double, id int")
    out = consensus(df, ["k"], F.col("v"), F.col("w"), F.col("id")).first()
    assert out["consensus"].split() == base
    assert out["distance"] == min(distance(v.split(), base) for v in values)


def test_very_long_values(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    other = long.replace("w10000", "zz") + " tail"
    df = spark.createDataFrame([(1, long, 2.0, 1), (1, other, 1.0, 2)], "k int, v string, w double, id int")
    assert consensus(df, ["k"], F.col("v"), F.col("w"), F.col("id")).first()["value"] == long
    assert s.CHUNK < 20_000


def test_insertions_move_nothing_in_very_long_values(monkeypatch):
    monkeypatch.setattr(s, "CHUNK", 60)
    r = random.Random(6)
    base = [f"w{i}" if i % 3 else "the" for i in range(900)]
    versions = [base]
    for k in range(4):
        own = list(base)
        own[40 + k : 40 + k] = [f"new{k}{i}" for i in range(25)]
        del own[500 + 7 * k : 505 + 7 * k]
        own[r.randrange(600, 850)] = "typo"
        versions.append(own)
    assert elected(profile_of([" ".join(v) for v in versions], [1.0] * 5)) == base
