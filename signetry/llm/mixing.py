"""Documents drawn from several sources so that each contributes its target share of all tokens.

A document of a listed source belongs to it. Documents without one are given domain posteriors by a naive Bayes
classifier over hashed words, fitted on the labelled rows. Nonnegative rates, at most the repeats a source
allows, are fitted by projected-gradient least squares on the expected tokens per domain; documents of equal
membership and cap share a rate, so the iterations run over distinct memberships. Rates become whole repeats:
very long documents, of which a source has few, are taken one by one in the order of a hash of their id, all others
by a threshold on that hash which is placed where the tokens of the source are met.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread, stored
from .tokens import VOCABULARY, token_count

FEATURES = 4096
LABELLED_PER_SOURCE = 2000  # rows per source the classifier is fitted on
STEPS = 200
SPARE = 1.5  # share by which the first cut of the labelled rows exceeds what is kept
LONG = 1000  # a document with more than this part of its source's tokens is decided on its own
CLOSE = 1e-7
CELLS = 1024


def _features(text: Column) -> Column:
    """Distinct hashed words of a text."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}_]+")
    return F.array_distinct(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(FEATURES)).cast("int")))


def fit_domains(labelled: DataFrame, domains: list[str], per_source: int = LABELLED_PER_SOURCE) -> tuple[np.ndarray, np.ndarray]:
    """Log priors and log odds per domain and feature, from at most ``per_source`` rows of each source."""
    prior = np.zeros(len(domains))
    totals = {r["source"]: r["n"] for r in labelled.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    for k, d in enumerate(domains):
        prior[k] = math.log(totals.get(d, 0) + 1)
    cuts = F.create_map(*[x for d in domains for x in (F.lit(d), F.lit(SPARE * per_source / max(totals.get(d, 0), 1)))])
    near = labelled.where((_uniform(F.col("doc_id")) < cuts[F.col("source")]) | F.col("doc_id").isNull())  # before the rank, so that no source is sorted whole
    rank = F.row_number().over(Window.partitionBy("source").orderBy(_uniform(F.col("doc_id")), "doc_id"))
    sample = near.withColumn("__rank", rank).where(F.col("__rank") <= per_source)
    rows = sample.select("source", _features(F.col("text")).alias("f"))
    counts = rows.select("source", F.explode("f").alias("f")).groupBy("source", "f").agg(F.count(F.lit(1)).alias("n")).collect()
    sizes = np.array([min(totals.get(d, 0), per_source) for d in domains], float)[:, None]
    seen = np.zeros((len(domains), FEATURES))
    place = {d: k for k, d in enumerate(domains)}
    for r in counts:
        seen[place[r["source"]], r["f"]] = r["n"]
    share = (seen + 0.5) / (sizes + 1.0)
    return prior, np.log(share / (1 - share))


def _posteriors(features: Column, prior: np.ndarray, odds: np.ndarray) -> Column:
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def predict(rows: pd.Series) -> pd.Series:
        out = []
        for f in rows:
            score = prior + (odds[:, np.asarray(f, int)].sum(1) if f is not None and len(f) else 0.0)
            p = np.exp(score - score.max())
            out.append([round(float(x), 4) for x in p / p.sum()])
        return pd.Series(out)

    return predict(features)


def rates_after(p: np.ndarray, cap: np.ndarray, history: np.ndarray) -> np.ndarray:
    """Rates of memberships ``p`` (rows) after the steps whose scaled residuals are ``history``."""
    rate = np.zeros(len(p))
    for residual in history:
        rate = np.clip(rate - p @ residual, 0.0, cap)
    return rate


def fit_rates(classes: DataFrame, wanted: np.ndarray, available: np.ndarray) -> tuple[np.ndarray, bool]:
    """History of scaled residuals of the projected gradient, which determines every rate, and whether it settled.

    ``classes`` has ``membership, cap, tokens``. Nothing but one sum per domain comes back from a step. It has
    settled when the residuals are met or no longer change, and goes on for STEPS at most.
    """
    k = len(wanted)
    history = np.zeros((0, k))
    names = [f"t{i}" for i in range(k)]
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in names])
    scale = np.maximum(available, 1.0)
    for _ in range(STEPS):

        def partial(frames, history=history):
            for frame in frames:
                if len(frame):
                    p = np.array(frame["membership"].tolist(), float).reshape(len(frame), k)
                    rate = rates_after(p, frame["cap"].to_numpy(float), history)
                    yield pd.DataFrame([(rate * frame["tokens"].to_numpy(float)) @ p], columns=names)

        sums = classes.mapInPandas(partial, schema).agg(*[F.sum(n) for n in names]).first()
        totals = np.array([x or 0.0 for x in sums])
        residual = (totals - wanted) / scale
        if len(history) and np.abs(residual * (available > 0)).max() < CLOSE:
            return history, True
        if len(history) > 1 and np.allclose(residual, history[-1], atol=CLOSE) and np.allclose(history[-1], history[-2], atol=CLOSE):
            return history, True
        history = np.vstack([history, residual])
    return history, False


def _uniform(key: Column) -> Column:
    """A number from 0 to 1 of a row's id, the same on any cluster."""
    return F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _thresholds(extra: DataFrame, needs: dict[str, float]) -> dict[str, float]:
    """Per source the number below which the documents' hashes hold about the needed tokens, found in two histograms."""
    low = {s: 0.0 for s in needs}
    open_ = {s: n for s, n in needs.items() if n > 0}
    width = 1.0
    out = {s: 0.0 for s in needs}
    for _ in range(3):
        if not open_:
            break
        width /= CELLS
        starts = F.create_map(*[x for s in open_ for x in (F.lit(s), F.lit(low[s]))])[F.col("source")]
        cell = F.floor((F.col("u") - starts) / width)
        counts = (
            extra.where(F.col("source").isin(*open_)).withColumn("cell", cell).where((F.col("cell") >= 0) & (F.col("cell") < CELLS))
            .groupBy("source", "cell").agg(F.sum("n_tokens").alias("n")).collect()
        )
        for s in list(open_):
            sums = np.zeros(CELLS)
            for r in counts:
                if r["source"] == s:
                    sums[r["cell"]] = r["n"]
            upto = np.cumsum(sums)
            at = int(np.searchsorted(upto, open_[s], "left"))
            if at >= CELLS:
                out[s] = low[s] + width * CELLS
                del open_[s]
                continue
            rest = open_[s] - (upto[at - 1] if at else 0.0)
            low[s] += at * width
            open_[s] = rest
            out[s] = low[s] + (width if rest > sums[at] / 2 else 0.0)
    return out


def _long_ones(extra: DataFrame, needs: dict[str, float], have: dict[str, float]) -> tuple[list[int], dict[str, float]]:
    """Very long documents to draw once more, and what each source then still needs.

    A source has at most LONG of them. They are taken in the order of their hash, each if it fits into the part
    of the need that falls to the long ones, and after that as long as the short ones can't meet the need.
    """
    least = F.create_map(*[x for d, n in have.items() for x in (F.lit(d), F.lit(n / LONG))])
    rows = extra.where(F.col("n_tokens") > least[F.col("source")]).select("doc_id", "source", "n_tokens", "u").collect()
    chosen, rest = [], dict(needs)
    for d, need in needs.items():
        own = sorted((r["u"], r["doc_id"], r["n_tokens"]) for r in rows if r["source"] == d and r["doc_id"] is not None)
        long = sum(n for _, _, n in own)
        share, short = need * long / max(have[d], 1.0), have[d] - long
        left = []
        for _, doc, n in own:
            if n <= share + have[d] / LONG / 2:
                chosen.append(doc)
                share, rest[d] = share - n, rest[d] - n
            else:
                left.append((doc, n))
        for doc, n in left:
            if rest[d] > short + n / 2:
                chosen.append(doc)
                rest[d] -= n
    return chosen, rest


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The drawn documents (doc_id, source, n_tokens, repeats) and the shares reached per source.

    Without ``total_tokens`` the mixture is as large as the scarcest listed source allows when it is repeated to
    its cap. A listed source without documents contributes nothing and is reported so; the others keep their
    proportions to each other. Documents of no listed source are used at most once, for the domains they
    resemble. Empty and null texts are never drawn. Null shares count as 0, null repeats as 1; a source listed
    twice has its shares added.
    """
    listed = {
        r["source"]: (max(r["share"] or 0.0, 0.0), max(int(r["cap"] or 1), 0))
        for r in targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap")).collect()
    }
    domains = sorted(listed)
    known = F.col("source").isin(*domains) if domains else F.lit(False)
    rows = spread(documents.select("doc_id", "source", "text")).withColumn("n_tokens", token_count(F.col("text"), vocabulary))
    rows = rows.withColumn("f", F.when(F.coalesce(known, F.lit(False)), F.lit(None)).otherwise(_features(F.coalesce("text", F.lit("")))))
    rows = stored(rows.where("n_tokens > 0").select("doc_id", "source", "n_tokens", "f"))
    labelled = documents.where(known).select("doc_id", "source", "text")
    tokens = {r["source"]: float(r["n"]) for r in rows.where(known).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    present = [d for d in domains if tokens.get(d)]
    if not present:
        empty = rows.select("doc_id", "source", "n_tokens", F.lit(0).alias("repeats")).limit(0)
        return empty, _shares(empty, listed, {}).withColumn("fit_settled", F.lit(True))
    prior, odds = fit_domains(labelled.where(F.col("source").isin(*present)), present)
    one_hot = F.array(*[F.when(F.col("source") == d, 1.0).otherwise(0.0) for d in present])
    is_present = F.coalesce(F.col("source").isin(*present), F.lit(False))
    caps = F.create_map(*[x for d in present for x in (F.lit(d), F.lit(listed[d][1]))])
    hard = rows.where(is_present).select("doc_id", "source", "n_tokens", one_hot.alias("membership"), caps[F.col("source")].alias("cap"))
    soft = rows.where(~is_present).select("doc_id", "source", "n_tokens", _posteriors(F.col("f"), prior, odds).alias("membership"), F.lit(1).alias("cap"))
    members = stored(hard.unionByName(soft))
    share = np.array([listed[d][0] for d in present])
    cap = np.array([listed[d][1] for d in present], float)
    have = np.array([tokens[d] for d in present])
    if total_tokens is None:
        total_tokens = min((h * c / s for h, c, s in zip(have, cap, share) if s > 0), default=0.0)
    wanted = share * total_tokens
    classes = stored(members.groupBy("membership", "cap").agg(F.sum("n_tokens").alias("tokens")))
    sums = classes.agg(*[F.sum(F.col("membership")[i] * F.col("tokens")) for i in range(len(present))]).first()
    available = np.array([x or 0.0 for x in sums])
    history, settled = fit_rates(classes, wanted, available)

    @F.pandas_udf(T.DoubleType())
    def rate(membership: pd.Series, cap: pd.Series) -> pd.Series:
        p = np.array(membership.tolist(), float).reshape(len(membership), len(present))
        return pd.Series(rates_after(p, cap.to_numpy(float), history))

    rated = members.withColumn("rate", F.round(rate("membership", "cap"), 9)).withColumn("u", _uniform(F.col("doc_id")))
    hard_rate = rates_after(np.eye(len(present)), cap, history)
    needs = {d: (hard_rate[i] - math.floor(hard_rate[i] + 1e-9)) * have[i] for i, d in enumerate(present)}
    tokens_of = {d: float(have[i]) for i, d in enumerate(present)}
    owned = rated.where(is_present).select("doc_id", "source", "n_tokens", "u")
    taken, rest = _long_ones(owned, needs, tokens_of)
    least = F.create_map(*[x for d in present for x in (F.lit(d), F.lit(tokens_of[d] / LONG))])
    cuts = _thresholds(owned.where(F.col("n_tokens") <= least[F.col("source")]), rest)
    cut = F.create_map(*[x for d in present for x in (F.lit(d), F.lit(float(cuts[d])))])
    spark = documents.sparkSession
    one_more = F.broadcast(spark.createDataFrame([(i,) for i in taken], documents.select("doc_id").schema).distinct().withColumn("taken", F.lit(True)))  # LONG a source at most
    rated = rated.join(one_more, "doc_id", "left")
    whole = F.floor(F.col("rate") + 1e-9)
    alone = F.col("n_tokens") > least[F.col("source")]
    again = F.when(~is_present, F.col("u") < F.col("rate") - whole).when(alone, F.col("taken").isNotNull()).otherwise(F.col("u") < cut[F.col("source")])
    repeats = F.least(whole + F.when(again, 1).otherwise(0), F.col("cap")).cast("int")
    chosen = rated.withColumn("repeats", repeats).where("repeats > 0")
    expected = {d: (float(w), i) for i, (d, w) in enumerate(zip(present, wanted))}
    return chosen.select("doc_id", "source", "n_tokens", "repeats"), _shares(chosen, listed, expected).withColumn("fit_settled", F.lit(settled))


def _shares(chosen: DataFrame, listed: dict, expected: dict) -> DataFrame:
    """Per source, listed or drawn: target, documents, tokens, share of all drawn tokens, and of expected domain tokens."""
    spark = chosen.sparkSession
    used = F.col("n_tokens") * F.col("repeats")
    by = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum(used).alias("tokens"), F.max("repeats").alias("most_repeats"))
    sums = [F.sum(used).alias("all")] + [F.sum(used * F.col("membership")[i]).alias(f"d{i}") for _, i in expected.values()]
    total = chosen.agg(*sums).first()
    every = float(total["all"] or 0) or 1.0
    rows = [(s, share, cap, expected.get(s, (0.0, 0))[0], float(total[f"d{expected[s][1]}"] or 0) / every if s in expected else 0.0) for s, (share, cap) in listed.items()]
    wanted = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, wanted_tokens double, domain_share double")
    out = wanted.join(by, "source", "full")
    return out.select(
        "source",
        F.round(F.coalesce("target_share", F.lit(0.0)), 6).alias("target_share"),
        "max_repeats",
        F.coalesce("n_documents", F.lit(0)).alias("n_documents"),
        F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.round(F.coalesce("wanted_tokens", F.lit(0.0)), 0).cast("bigint").alias("wanted_tokens"),
        F.round(F.coalesce("tokens", F.lit(0)) / F.lit(every), 6).alias("actual_share"),
        F.round(F.coalesce("domain_share", F.lit(0.0)), 6).alias("domain_share"),
    )
