"""Sign-prediction examples, the logistic probe, its metrics, and the choice of a configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hash_uniform, pair_high, pair_low, three_class_label, two_class_label
from ..session import stored
from .interventions import non_edges

SPLITS = ("train", "val", "test")
CONFIG = ("input_dimension", "output_dimension", "layers", "learning_rate", "epochs", "class_weight")


def forbidden_pairs(base_train: DataFrame, train: DataFrame, val: DataFrame, test: DataFrame) -> DataFrame:
    """``split, source, target``: pairs that are no non-edges of a split, the history up to it.

    Evaluation splits look at the training graph before any augmentation, so adding edges leaves theirs alone.
    """
    history = {"train": [train], "val": [base_train, val], "test": [base_train, val, test]}
    out = None
    for split, parts in history.items():
        for part in parts:
            own = part.select(F.lit(split).alias("split"), pair_low().alias("source"), pair_high().alias("target"))
            out = own if out is None else out.unionByName(own)
    return out.distinct()


def three_class_examples(base_train: DataFrame, train: DataFrame, val: DataFrame, test: DataFrame, num_nodes: int, seed: int = 0, directed: bool = False) -> DataFrame:
    """``split, source, target, label``: signed edges and as many hashed non-edges per split, or all there are."""
    forbidden = stored(forbidden_pairs(base_train, train, val, test))
    out = None
    for split, part in zip(SPLITS, (train, val, test)):
        signed = part.select(F.lit(split).alias("split"), "source", "target", three_class_label().alias("label"))
        free = non_edges(num_nodes, forbidden.where(F.col("split") == split), part.count(), f"{seed}|{split}", strict=False)
        flip = (hash_uniform(f"{seed}|{split}|way", "source", "target") < 0.5) if directed else F.lit(False)
        none = free.select(
            F.lit(split).alias("split"), F.when(flip, F.col("target")).otherwise(F.col("source")).alias("source"), F.when(flip, F.col("source")).otherwise(F.col("target")).alias("target"), F.lit(2).alias("label")
        )
        out = signed.unionByName(none) if out is None else out.unionByName(signed).unionByName(none)
    return out


def two_class_examples(train: DataFrame, val: DataFrame, test: DataFrame) -> DataFrame:
    """``split, source, target, label``: 1 for positive, 0 for negative edges."""
    parts = [p.select(F.lit(s).alias("split"), "source", "target", two_class_label().alias("label")) for s, p in zip(SPLITS, (train, val, test))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def label_histogram(examples: DataFrame) -> DataFrame:
    return examples.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


def endpoint_features(examples: DataFrame, state: DataFrame) -> DataFrame:
    """``examples`` with ``features``, the state of the source followed by that of the target."""
    s = state.select(F.col("node_id").alias("source"), F.col("state").alias("__a"))
    t = state.select(F.col("node_id").alias("target"), F.col("state").alias("__b"))
    both = examples.join(s, "source").join(t, "target")
    return both.withColumn("features", F.concat("__a", "__b").cast("array<double>")).drop("__a", "__b")


def fit_probe(rows: DataFrame, balanced: bool = False, c: float = 1.0, iterations: int = 5000):
    """Logistic regression on ``features, label`` with squared weights penalised as 1/(2 c) against the summed loss."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = rows.select(array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label"))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    weights = {k: total / (len(counts) * n) if balanced else 1.0 for k, n in counts.items()}
    rows = rows.withColumn("weight", F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("label")])
    family = "multinomial" if max(counts) > 1 else "binomial"
    model = LogisticRegression(family=family, regParam=1.0 / (c * total), standardization=False, maxIter=iterations, weightCol="weight", tol=1e-8)
    kept = rows.persist()  # training reads its rows once per step
    try:
        return model.fit(kept)
    finally:
        kept.unpersist()


def predict(model, rows: DataFrame) -> DataFrame:
    """``rows`` with ``prediction`` INT and ``score``, the probability of the last class."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    scored = model.transform(rows.withColumn("__f", array_to_vector("features")).withColumnRenamed("features", "__raw").withColumnRenamed("__f", "features"))
    kept = scored.drop("features").withColumnRenamed("__raw", "features")
    return kept.select(*rows.columns, F.col("prediction").cast("int").alias("prediction"), F.element_at(vector_to_array("probability"), -1).alias("score"))


# ---------------------------------------------------------------------------------- metrics
def confusion(predicted: DataFrame, labels: list[int], truth: str = "label", guess: str = "prediction") -> DataFrame:
    """``truth, prediction, n`` for every pair of the fixed labels, zeros included."""
    spark = predicted.sparkSession
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], "truth int, prediction int")
    counts = predicted.groupBy(F.col(truth).cast("int").alias("truth"), F.col(guess).cast("int").alias("prediction")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["truth", "prediction"], "left").select("truth", "prediction", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def class_f1(matrix: DataFrame) -> DataFrame:
    """``label, support, predicted, f1`` per label; f1 is 0 where there is nothing to divide by."""
    rows = matrix.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"))
    columns = matrix.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("predicted"))
    hits = matrix.where("truth = prediction").select(F.col("truth").alias("label"), F.col("n").alias("hits"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("hits"), (F.col("support") + F.col("predicted")).cast("double")), F.lit(0.0))
    return rows.join(columns, "label").join(hits, "label").select("label", "support", "predicted", "hits", f1.alias("f1"))


def f1_report(matrix: DataFrame) -> DataFrame:
    """One row ``accuracy, macro_f1, weighted_f1``; macro averages over labels that occur as truth or prediction."""
    by = class_f1(matrix)
    occurs = (F.col("support") + F.col("predicted")) > 0
    return by.agg(
        F.try_divide(F.sum("hits").cast("double"), F.sum("support").cast("double")).alias("accuracy"),
        F.avg(F.when(occurs, F.col("f1"))).alias("macro_f1"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support").cast("double")).alias("weighted_f1"),
    )


def auc(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row ``auc``: the share of positive-negative pairs in the right order, ties counting half; null for one class.

    Ranks come from counts per distinct score, added up over ranges of scores, so no task sorts the whole table.
    """
    from .ranking import global_rank

    counts = scored.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n"))
    ranked = stored(global_rank(counts.withColumn("neg", F.col("n") - F.col("pos")), ["s"], "r"))
    part = F.floor(F.col("r") / 10_000)
    parts = ranked.groupBy(part.alias("part")).agg(F.sum("neg").alias("neg"))
    below = parts.select("part", F.coalesce(F.sum("neg").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"))
    inside = F.coalesce(F.sum("neg").over(Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranked.withColumn("part", part).withColumn("inside", inside).join(below, "part")
    wins = F.sum(F.col("pos") * (F.col("below") + F.col("inside") + F.col("neg") / 2))
    return placed.agg(F.try_divide(wins, (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


def probe_metrics(train: DataFrame, evaluation: DataFrame, labels: list[int], balanced: bool = False) -> DataFrame:
    """One row of accuracy, F1 scores and, for two classes, AUC of a probe fitted on ``train``."""
    predicted = stored(predict(fit_probe(train, balanced), evaluation))
    out = f1_report(confusion(predicted, labels))
    if len(labels) == 2:
        return out.join(auc(predicted), how="cross")  # two tables of one row
    return out.withColumn("auc", F.lit(None).cast("double"))


# ---------------------------------------------------------------------------------- tuning
def grid(spark, **choices: list) -> DataFrame:
    """Every combination of the choices; a small table made on the driver."""
    from itertools import product

    import pandas as pd

    return spark.createDataFrame(pd.DataFrame(list(product(*choices.values())), columns=list(choices)))


def select_configuration(runs: DataFrame, config: list[str] | None = None, metric: str = "validation_macro_f1", seed: str = "seed") -> DataFrame:
    """One row: the configuration with the best mean over all seeds; those that lack a seed are out.

    Equal means go to the smallest configuration, compared column by column. A null deviation counts as 0.
    """
    config = config or [c for c in CONFIG if c in runs.columns]
    seeds = runs.agg(F.countDistinct(seed).alias("n")).scalar()
    by = runs.groupBy(*config).agg(F.avg(metric).alias("mean"), F.coalesce(F.stddev_samp(metric), F.lit(0.0)).alias("std"), F.countDistinct(seed).alias("n_seeds"))
    return by.where(F.col("n_seeds") == seeds).orderBy(F.round("mean", 12).desc(), *config).limit(1)


def runs_of(runs: DataFrame, selected: DataFrame, config: list[str] | None = None) -> DataFrame:
    """The runs of the selected configuration."""
    config = config or [c for c in CONFIG if c in runs.columns]
    return runs.join(F.broadcast(selected.select(*config)), config, "left_semi")


def run_token(value: float | int | str) -> str:
    """A value as part of a path: 0.01 becomes 0p01."""
    return str(value).replace(".", "p").replace("-", "m")


def final_report(measurements: DataFrame, metrics: DataFrame) -> DataFrame:
    """Per seed the measurement joined to its metrics, and a row ``all`` with means and deviations; nulls are skipped."""
    each = measurements.join(metrics, "seed")
    names = [c for c, kind in each.dtypes if kind == "double"]
    summary = each.agg(*[F.avg(c).alias(f"{c}_mean") for c in names], *[F.stddev_samp(c).alias(f"{c}_std") for c in names])
    return each.select(F.col("seed").cast("string").alias("seed"), *names).unionByName(summary.select(F.lit("mean").alias("seed"), *[F.col(f"{c}_mean").alias(c) for c in names])).unionByName(
        summary.select(F.lit("std").alias("seed"), *[F.col(f"{c}_std").alias(c) for c in names])
    )


def averaged(rows: DataFrame, by: list[str], metric: str) -> DataFrame:
    """Mean, sample deviation, coefficient of variation (null where the mean is 0) and count per group."""
    out = rows.groupBy(*by).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("cv", F.try_divide("std", "mean"))


def spearman(rows: DataFrame, by: list[str], x: str, y: str, least_spread: float = 1e-12) -> DataFrame:
    """``by, rho``: rank correlation per replicate, replicates without spread in x or y left out."""
    w = lambda c: Window.partitionBy(*by).orderBy(c)
    same = lambda c: Window.partitionBy(*by, c)

    def average_rank(c: str) -> Column:
        return F.rank().over(w(c)) + (F.count(F.lit(1)).over(same(c)) - 1) / 2

    ranked = rows.select(*by, F.col(x).alias("x"), F.col(y).alias("y"), average_rank(x).alias("rx"), average_rank(y).alias("ry"))
    out = ranked.groupBy(*by).agg(F.corr("rx", "ry").alias("rho"), (F.max("x") - F.min("x")).alias("sx"), (F.max("y") - F.min("y")).alias("sy"))
    return out.where((F.col("sx") > least_spread) & (F.col("sy") > least_spread)).drop("sx", "sy")
