import numpy as np
import pytest

from signetry.llm.mixing import mix, rates_after
from signetry.llm.tokens import token_count

DOCS = "doc_id bigint, source string, text string, n_tokens string, repeats int"
TARGETS = "source string, target_share double, max_repeats int"


def _documents(spark, spec, seed=0):
    rng = np.random.default_rng(seed)
    words = {s: [f"{s}{i}" for i in range(30)] for s in spec}
    out, k = [], 0
    for s, n in spec.items():
        for _ in range(n):
            out.append((k, s, " ".join(rng.choice(words[s], rng.integers(5, 40))), "clash", 9))
            k += 1
    return out, words


def test_shares_are_met_within_a_document(spark):
    docs, words = _documents(spark, {"a": 400, "b": 200, "c": 60, "x": 20})
    docs += [(5000 + i, None, " ".join(words["a"]), "clash", 9) for i in range(5)] + [(6000, "a", None, "", 0), (6001, "b", "", "", 0)]
    df = spark.createDataFrame(docs, DOCS)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("none", 0.1, 4), (None, 0.5, 1)], TARGETS)
    chosen, shares = mix(df, targets)
    rows = {r["source"]: r for r in shares.collect()}
    assert rows["none"]["tokens"] == 0 and rows["none"]["target_share"] == 0.1
    for s, cap in (("a", 1), ("b", 2), ("c", 3)):
        assert rows[s]["most_repeats"] <= cap
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):  # expected tokens of the domain, unlisted documents counted by posterior
        assert rows[s]["domain_share"] == pytest.approx(share, abs=0.02)
    assert chosen.select("doc_id").distinct().count() == chosen.count()
    assert {6000, 6001}.isdisjoint(r["doc_id"] for r in chosen.collect())


def test_a_few_very_long_documents_do_not_upset_the_shares(spark):
    docs, words = _documents(spark, {"a": 300, "b": 300, "c": 40})
    docs += [(7000 + i, "b", " ".join(words["b"] * (40 + 25 * i)), "clash", 9) for i in range(5)]
    targets = spark.createDataFrame([("a", 0.45, 1), ("b", 0.4, 1), ("c", 0.15, 2)], TARGETS)
    _, shares = mix(spark.createDataFrame(docs, DOCS), targets)
    rows = {r["source"]: r for r in shares.collect()}
    assert all(r["fit_settled"] for r in rows.values())
    for s, share in (("a", 0.45), ("b", 0.4), ("c", 0.15)):
        assert rows[s]["actual_share"] == pytest.approx(share, abs=0.01)


def test_unlabelled_documents_help_the_domain_they_resemble(spark):
    docs, words = _documents(spark, {"a": 100, "b": 100})
    docs += [(9000, None, " ".join(words["b"] * 2), "", 0)]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], TARGETS)
    _, shares = mix(spark.createDataFrame(docs, DOCS), targets)
    rows = {r["source"]: r for r in shares.collect()}
    assert rows["a"]["domain_share"] == pytest.approx(0.5, abs=0.03) and rows["b"]["domain_share"] == pytest.approx(0.5, abs=0.03)


def test_no_documents_or_no_targets(spark):
    docs, _ = _documents(spark, {"a": 3})
    df = spark.createDataFrame(docs, DOCS)
    targets = spark.createDataFrame([("a", 0.5, None)], TARGETS)
    chosen, shares = mix(df.limit(0), targets)
    assert chosen.count() == 0 and shares.first()["tokens"] == 0
    chosen, _ = mix(df, targets.limit(0))
    assert chosen.count() == 0
    chosen, _ = mix(df, targets)
    assert chosen.count() == 3


def test_rates_stay_between_zero_and_cap():
    p, cap = np.array([[1.0, 0.0], [0.5, 0.5]]), np.array([2.0, 1.0])
    assert rates_after(p, cap, np.array([[-5.0, 1.0]])).tolist() == [2.0, 1.0]
    assert rates_after(p, cap, np.array([[5.0, 5.0]])).tolist() == [0.0, 0.0]


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "a" * 200_000)], "id int, text string")
    n = {r["id"]: r["n"] for r in df.select("id", token_count(df["text"]).alias("n")).collect()}
    assert n[1] == 2 and n[2] == 0 and n[3] == 0 and n[4] > 1000
