"""Queries of examples, features, probes, metrics, configurations, synthetic graphs and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import hash_uniform
from ..operators import learning, synthetic
from ..session import stored
from .inputs import LABEL_SQL, NODES, SPLIT_SQL, VECTOR_SQL, node_count, registered, short_coordinates, uniform_sql, vector_graph, vector_labels, vector_splits, vector_state

N, K = 200, 4


def _splits(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {k: stored(v) for k, v in vector_splits(spark, sf_dir).items()}


def signed_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.two_class_examples(**vector_splits(spark, sf_dir))


def forbidden_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = vector_splits(spark, sf_dir)
    return learning.forbidden_pairs(parts["train"], **parts)


def three_class_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _splits(spark, sf_dir)
    return learning.three_class_examples(parts["train"], **parts, num_nodes=node_count(spark, sf_dir), seed=3)


def label_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.label_histogram(signed_examples(spark, sf_dir))


def endpoint_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = short_coordinates(spark, sf_dir).withColumnRenamed("value", "state")
    rows = learning.endpoint_features(signed_examples(spark, sf_dir), state)
    return rows.select("split", "source", "target", "label", F.posexplode("features").alias("at", "x")).withColumn("at", F.col("at").cast("int")).withColumn("x", F.round("x", 6) + F.lit(0.0))


def _ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up predictor whose guesses and scores come from hashes."""
    rows = signed_examples(spark, sf_dir)
    return rows.withColumn("score", F.round(hash_uniform("score", "source", "target"), 2)).withColumn("prediction", (F.col("score") > 0.3).cast("int"))


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.confusion(_ruled(spark, sf_dir), [0, 1, 2])


def class_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.class_f1(confusion_matrix(spark, sf_dir)).withColumn("f1", F.round("f1", 6))


def f1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.f1_report(confusion_matrix(spark, sf_dir)).select(*[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")])


def auc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.auc(_ruled(spark, sf_dir)).select(F.round("auc", 6).alias("auc"))


def probe_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(learning.endpoint_features(signed_examples(spark, sf_dir), vector_state(spark, sf_dir)))
    return learning.probe_metrics(rows.where("split = 'train'"), rows.where("split = 'test'"), [0, 1], balanced=True)


def _runs(spark: SparkSession) -> DataFrame:
    rows = [(s, lr, ep, f) for lr, ep, values in ((0.01, 50, (0.9, 0.4, 0.4)), (0.001, 50, (0.7, 0.7, 0.7)), (0.001, 100, (0.99, 0.99, None))) for s, f in enumerate(values) if f is not None]
    return spark.createDataFrame(rows, "seed int, learning_rate double, epochs int, validation_macro_f1 double")


def config_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.grid(spark, learning_rate=[0.01, 0.001, 0.0001], epochs=[50, 100, 200])


def select_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.select_configuration(_runs(spark)).withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


def selected_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark)
    return learning.runs_of(runs, learning.select_configuration(runs))


def level_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signed_examples(spark, sf_dir).withColumn("x", hash_uniform("level", "source", "target"))
    out = learning.averaged(rows, ["split", "label"], "x")
    return out.select("split", "label", *[F.round(c, 6).alias(c) for c in ("mean", "std", "cv")], "n")


def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signed_examples(spark, sf_dir).withColumn("x", F.round(hash_uniform("x", "source", "target"), 2)).withColumn("y", F.col("x") + F.round(hash_uniform("y", "source", "target"), 1))
    return learning.spearman(rows, ["split"], "x", "y").withColumn("rho", F.round("rho", 6))


def final_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = spark.createDataFrame([(0, 2.0), (1, 3.0), (2, 4.0)], "seed int, polarization double")
    two = spark.createDataFrame([(0, 0.5, None), (1, 0.7, 0.8), (2, 0.6, 0.9)], "seed int, test_macro_f1 double, test_auc double")
    out = learning.final_report(one, two)
    return out.select("seed", *[F.round(c, 6).alias(c) for c in out.columns if c != "seed"])


# ---------------------------------------------------------------------------------- synthetic graphs
def balanced_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.balanced_communities(spark, 203, K)


def sbm_pair_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.pair_pools(synthetic.balanced_communities(spark, N, K))


def allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(t, s, *synthetic.allocation(t, s)) for t, s in ((5, 0.5), (7, 0.5), (1000, 0.95), (10, 0.25))]
    return spark.createDataFrame(rows, "total bigint, share double, inside bigint, outside bigint")


def exact_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.exact_layer(sbm_pair_pools(spark, sf_dir), 500, 0.8, 5)


def bernoulli_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.bernoulli_layer(sbm_pair_pools(spark, sf_dir), 0.2, 0.02, 5)


def structural_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = synthetic.structural_panel(spark, N, K, 1500, 300, [0.6, 0.9], [0.6, 0.95])
    return panel.groupBy("level", "sign").agg(F.count(F.lit(1)).alias("n"))


def prevalence_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    pools = stored(sbm_pair_pools(spark, sf_dir))
    positive = synthetic.exact_layer(pools, 900, 0.8, "p")
    return synthetic.prevalence_panel(positive, pools, [0.0, 0.1, 0.25], 0.95).groupBy("level", "sign").agg(F.count(F.lit(1)).alias("n"))


def signed_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    pools = stored(sbm_pair_pools(spark, sf_dir))
    positive = synthetic.exact_layer(pools, 500, 0.8, "p")
    negative = synthetic.exact_layer(pools, 100, 0.1, "n", positive.select("source", "target"))
    return synthetic.signed_edges(positive, negative, 1)


P_OUTS, EXPECTED, FRACTIONS = [0.005, 0.02, 0.04], 1200.0, [0.2, 0.5, 0.8]


def unsigned_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.unsigned_panel(spark, N, K, EXPECTED, P_OUTS)


def signed_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    pools = stored(sbm_pair_pools(spark, sf_dir))
    return synthetic.signed_panel(stored(synthetic.exact_layer(pools, 900, 0.8, "p")), pools, 300, FRACTIONS)


def inter_community_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.inter_community_edges(vector_graph(spark, sf_dir), vector_labels(spark, sf_dir))


def panel_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States trained and measured on the levels of a structural panel."""
    from ..operators.encoders import EncoderConfig
    from ..pipeline import panel_measurements as measured

    panel = stored(synthetic.structural_panel(spark, N, K, 1500, 300, [0.6, 0.9], [0.6, 0.95]))
    return measured(panel, N, 4, [0], config=EncoderConfig(8, 8, 2, 0.02, 30))


def held_out_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pools = stored(sbm_pair_pools(spark, sf_dir))
    return synthetic.held_out(synthetic.exact_layer(pools, 500, 0.8, 5), pools, 100, 0.2, 9)


def generated_opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = synthetic.balanced_communities(spark, N, K)
    parts = [synthetic.opinions(nodes, d, 1).select(F.lit(d).alias("distribution"), "node_id", (F.round("opinion", 6) + F.lit(0.0)).alias("opinion")) for d in ("uniform", "power_law", "aligned", "reflected_normal")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def permuted_opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = synthetic.opinions(synthetic.balanced_communities(spark, N, K), "uniform", 1)
    return synthetic.permuted_opinions(values, 2).withColumn("opinion", F.round("opinion", 6) + F.lit(0.0))


def node_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.layout(synthetic.balanced_communities(spark, N, K), K).withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("layout_x", "layout_y")})


def er_panel_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = synthetic.balanced_communities(spark, N, K)
    panel = stored(synthetic.structural_panel(spark, N, K, 1500, 300, [0.6, 0.9], [0.6, 0.95]))
    aligned = synthetic.opinions(nodes, "aligned", 1)
    return synthetic.baseline_report(panel, {"aligned": aligned, "permuted": synthetic.permuted_opinions(aligned, 2)}, N)


_EX = "ex AS (SELECT split, source, target, CASE WHEN sign > 0 THEN 1 ELSE 0 END AS label FROM sp)"
_G = f"{VECTOR_SQL}, {SPLIT_SQL}, {_EX}"
_RULED = f"ru AS (SELECT *, round({uniform_sql(repr('score'), 'source', 'target')}, 2) AS score, CAST(round({uniform_sql(repr('score'), 'source', 'target')}, 2) > 0.3 AS INTEGER) AS prediction FROM ex)"
_CM = "cm AS (SELECT t.range AS truth, p.range AS prediction, (SELECT count(*) FROM ru WHERE label = t.range AND ru.prediction = p.range) AS n FROM range(3) t, range(3) p)"
_F1 = """f1 AS (SELECT l.range AS label, CAST((SELECT sum(n) FROM cm WHERE truth = l.range) AS BIGINT) AS support, CAST((SELECT sum(n) FROM cm WHERE prediction = l.range) AS BIGINT) AS predicted, (SELECT n FROM cm WHERE truth = l.range AND prediction = l.range) AS hits FROM range(3) l),
ff AS (SELECT *, CASE WHEN support + predicted > 0 THEN 2.0::DOUBLE * hits / (support + predicted) ELSE 0 END AS f1 FROM f1)"""
_FORBID = "fb AS (SELECT 'train' AS split, source, target FROM sp WHERE split = 'train' UNION SELECT 'val', source, target FROM sp WHERE split IN ('train', 'val') UNION SELECT 'test', source, target FROM sp)"
_POOL = f"nodes AS (SELECT range AS node_id, range // {N // K} AS community FROM range({N})), pool AS (SELECT a.node_id AS source, b.node_id AS target, a.community = b.community AS same FROM nodes a JOIN nodes b ON a.node_id < b.node_id)"


def _ranked(total: int, share: float, seed: str) -> str:
    inside, outside = synthetic.allocation(total, share)
    return f"SELECT source, target, same FROM pool QUALIFY row_number() OVER (PARTITION BY same ORDER BY md5(concat_ws('|', '{seed}', source, target)), source, target) <= CASE WHEN same THEN {inside} ELSE {outside} END"


ORACLE = {
    "signed_examples": f"WITH {_G} SELECT split, source, target, CAST(label AS INTEGER) AS label FROM ex",
    "forbidden_pairs": f"WITH {_G}, {_FORBID} SELECT split, source, target FROM fb",
    "three_class_examples": f"""WITH {_G}, {_FORBID}, cnt AS (SELECT split, count(*) AS n FROM sp GROUP BY split),
free AS (SELECT c.split, c.n, a.range AS source, b.range AS target FROM cnt c, range({NODES}) a, range({NODES}) b WHERE a.range < b.range),
picked AS (SELECT f.* FROM free f LEFT JOIN fb ON fb.split = f.split AND fb.source = f.source AND fb.target = f.target WHERE fb.split IS NULL
  QUALIFY row_number() OVER (PARTITION BY f.split ORDER BY md5(concat_ws('|', '3|' || f.split, f.source, f.target)), f.source, f.target) <= n)
SELECT split, source, target, CASE WHEN sign > 0 THEN 0 ELSE 1 END AS label FROM sp UNION ALL SELECT split, source, target, 2 FROM picked""",
    "label_histogram": f"WITH {_G} SELECT split, CAST(label AS INTEGER) AS label, count(*) AS n FROM ex GROUP BY ALL",
    "endpoint_features": f"""WITH {_G}, st AS (SELECT vec_id AS node_id, CAST(i - 1 AS INTEGER) AS axis, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 5) r(i) WHERE vec_id < 500)
SELECT split, source, target, label, axis AS at, round(x, 6) + 0.0 AS x FROM ex JOIN st ON node_id = source UNION ALL SELECT split, source, target, label, axis + 4, round(x, 6) + 0.0 FROM ex JOIN st ON node_id = target""",
    "confusion_matrix": f"WITH {_G}, {_RULED}, {_CM} SELECT CAST(truth AS INTEGER) AS truth, CAST(prediction AS INTEGER) AS prediction, n FROM cm",
    "class_f1": f"WITH {_G}, {_RULED}, {_CM}, {_F1} SELECT CAST(label AS INTEGER) AS label, support, predicted, hits, round(f1, 6) AS f1 FROM ff",
    "f1_report": f"WITH {_G}, {_RULED}, {_CM}, {_F1} SELECT round(sum(hits) / sum(support), 6) AS accuracy, round(avg(f1) FILTER (support + predicted > 0), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM ff",
    "auc_rank": f"""WITH {_G}, {_RULED}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS rk FROM ru), c AS (SELECT sum(label)::DOUBLE AS p, count(*) - sum(label) AS n, sum(rk * label) AS s FROM r)
SELECT round((s - p * (p + 1) / 2) / (p * n), 6) AS auc FROM c""",
    "config_grid": "SELECT learning_rate::DOUBLE AS learning_rate, epochs::BIGINT AS epochs FROM (SELECT unnest([0.01, 0.001, 0.0001]) AS learning_rate), (SELECT unnest([50, 100, 200]) AS epochs)",
    "select_config": "SELECT 0.001::DOUBLE AS learning_rate, 50::INTEGER AS epochs, 0.7::DOUBLE AS mean, 0.0::DOUBLE AS std, 3::BIGINT AS n_seeds",
    "selected_runs": "SELECT unnest([0, 1, 2])::INTEGER AS seed, 0.001::DOUBLE AS learning_rate, 50::INTEGER AS epochs, 0.7::DOUBLE AS validation_macro_f1",
    "level_aggregate": f"""WITH {_G}, v AS (SELECT split, CAST(label AS INTEGER) AS label, {uniform_sql(repr("level"), "source", "target")} AS x FROM ex)
SELECT split, label, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(stddev_samp(x) / avg(x), 6) AS cv, count(*) AS n FROM v GROUP BY ALL""",
    "spearman": f"""WITH {_G}, v AS (SELECT split, round({uniform_sql(repr("x"), "source", "target")}, 2) AS x, round({uniform_sql(repr("y"), "source", "target")}, 1) AS y0 FROM ex), w AS (SELECT split, x, x + y0 AS y FROM v),
r AS (SELECT split, rank() OVER (PARTITION BY split ORDER BY x) + (count(*) OVER (PARTITION BY split, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY split ORDER BY y) + (count(*) OVER (PARTITION BY split, y) - 1) / 2.0::DOUBLE AS ry FROM w)
SELECT split, round(corr(rx, ry), 6) AS rho FROM r GROUP BY split""",
    "final_report": """WITH e AS (SELECT * FROM (VALUES ('0', 2.0::DOUBLE, 0.5::DOUBLE, NULL::DOUBLE), ('1', 3.0, 0.7, 0.8), ('2', 4.0, 0.6, 0.9)) t(seed, polarization, test_macro_f1, test_auc))
SELECT * FROM e UNION ALL SELECT 'mean', round(avg(polarization), 6), round(avg(test_macro_f1), 6), round(avg(test_auc), 6) FROM e UNION ALL SELECT 'std', round(stddev_samp(polarization), 6), round(stddev_samp(test_macro_f1), 6), round(stddev_samp(test_auc), 6) FROM e""",
    "balanced_communities": "SELECT range AS node_id, CAST(CASE WHEN range < 153 THEN range // 51 ELSE 3 + (range - 153) // 50 END AS INTEGER) AS community FROM range(203)",
    "sbm_pair_pools": f"WITH {_POOL} SELECT source, target, same FROM pool",
    "allocation": "SELECT total::BIGINT AS total, share::DOUBLE AS share, CAST(round_even(total * share::DOUBLE, 0) AS BIGINT) AS inside, total - CAST(round_even(total * share::DOUBLE, 0) AS BIGINT) AS outside FROM (VALUES (5, 0.5), (7, 0.5), (1000, 0.95), (10, 0.25)) t(total, share)",
    "exact_layer": f"WITH {_POOL} {_ranked(500, 0.8, '5')}",
    "bernoulli_layer": f"WITH {_POOL} SELECT source, target, same FROM pool WHERE {uniform_sql(repr('5'), 'source', 'target')} < CASE WHEN same THEN 0.2 ELSE 0.02 END",
    "structural_panel": "SELECT level::INTEGER AS level, sign::INTEGER AS sign, n::BIGINT AS n FROM (VALUES (0, 1, 1500), (0, -1, 300), (1, 1, 1500), (1, -1, 300)) t(level, sign, n)",
    "prevalence_panel": "SELECT level::INTEGER AS level, sign::INTEGER AS sign, n::BIGINT AS n FROM (VALUES (0, 1, 900), (1, 1, 900), (1, -1, 100), (2, 1, 900), (2, -1, 300)) t(level, sign, n)",
    "held_out_pairs": f"""WITH {_POOL}, train AS ({_ranked(500, 0.8, "5")}), r AS (SELECT source, target, row_number() OVER (ORDER BY md5(concat_ws('|', '9', source, target)), source, target) AS k FROM pool ANTI JOIN train USING (source, target))
SELECT source, target, CASE WHEN k <= 20 THEN -1 ELSE 1 END AS sign FROM r WHERE k <= 100""",
    "signed_generator": f"""WITH {_POOL}, pos AS ({_ranked(500, 0.8, "p")}), rest AS (SELECT * FROM pool ANTI JOIN pos USING (source, target)),
neg AS (SELECT source, target FROM rest QUALIFY row_number() OVER (PARTITION BY same ORDER BY md5(concat_ws('|', 'n', source, target)), source, target) <= CASE WHEN same THEN 10 ELSE 90 END),
rows_ AS (SELECT source, target, 1 AS sign FROM pos UNION ALL SELECT source, target, -1 FROM neg),
num AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '1|order', source, target)), source, target) - 1 AS event_id, {uniform_sql("'1|way'", "source", "target")} < 0.5 AS flip FROM rows_)
SELECT event_id, CASE WHEN flip THEN target ELSE source END AS source, CASE WHEN flip THEN source ELSE target END AS target, CAST(sign AS INTEGER) AS sign, CAST(sign AS DOUBLE) AS weight FROM num""",
    "generated_opinions": f"""WITH n AS (SELECT range AS node_id, {uniform_sql("'1|u'", "range")} AS u, {uniform_sql("'1|v'", "range")} AS v FROM range({N})),
s AS (SELECT *, CASE WHEN v < 0.5 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS side, greatest(u, 1e-12::DOUBLE) AS t FROM n),
r AS (SELECT *, side * 0.5::DOUBLE + 0.2::DOUBLE * sqrt(-2 * ln(t)) * cos(2 * pi() * v) + 1 AS w FROM s), f AS (SELECT *, w - 4 * floor(w / 4) AS m FROM r)
SELECT 'uniform' AS distribution, node_id, round(2 * u - 1, 6) + 0.0 AS opinion FROM s UNION ALL SELECT 'power_law', node_id, round(side * least(pow(t, -1.0::DOUBLE / 1.5) - 1, 1.0), 6) + 0.0 FROM s
UNION ALL SELECT 'aligned', node_id, round(side * (0.5::DOUBLE + u / 2), 6) + 0.0 FROM s UNION ALL SELECT 'reflected_normal', node_id, round(CASE WHEN m > 2 THEN 4 - m ELSE m END - 1, 6) + 0.0 FROM f""",
    "node_layout": f"""WITH n AS (SELECT range AS node_id, CAST(range // {N // K} AS INTEGER) AS community, {uniform_sql("'0|turn'", "range")} AS turn, {uniform_sql("'0|far'", "range")} AS far FROM range({N})),
a AS (SELECT *, 2 * pi() * community / {K} AS angle, 2 * pi() * turn AS t, 0.25::DOUBLE * sqrt(far) AS f FROM n)
SELECT node_id, community, round(cos(angle) + f * cos(t), 6) + 0.0 AS layout_x, round(sin(angle) + f * sin(t), 6) + 0.0 AS layout_y FROM a""",
    "permuted_opinions": f"""WITH v AS (SELECT range AS node_id, 2 * {uniform_sql("'1|u'", "range")} - 1 AS opinion FROM range({N})), a AS (SELECT opinion, row_number() OVER (ORDER BY opinion, node_id) AS k FROM v), b AS (SELECT node_id, row_number() OVER (ORDER BY md5(concat_ws('|', '50002', node_id)), node_id) AS k FROM v)
SELECT node_id, round(opinion, 6) + 0.0 AS opinion FROM a JOIN b USING (k)""",
}

def _probability_sql(level_probabilities: list[tuple[float, float]], seed: str) -> str:
    rows = ", ".join(f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for i, (a, b) in enumerate(level_probabilities))
    return f"SELECT level, source, target FROM free, (VALUES {rows}) p(level, inside, outside) WHERE {uniform_sql(repr(seed), 'source', 'target')} < CASE WHEN same THEN inside ELSE outside END"


ORACLE |= {
    "unsigned_panel": f"WITH {_POOL}, free AS (SELECT * FROM pool), drawn AS ({_probability_sql([(synthetic.within_probability(N, K, EXPECTED, p), p) for p in P_OUTS], '0|0|positive')}) SELECT CAST(level AS INTEGER) AS level, source, target, 1 AS sign FROM drawn",
    "signed_panel": f"""WITH {_POOL}, pos AS ({_ranked(900, 0.8, "p")}), free AS (SELECT * FROM pool ANTI JOIN pos USING (source, target)),
q AS (SELECT level, 300.0::DOUBLE * (1 - f) / (SELECT count(*) FROM free WHERE same) AS inside, 300.0::DOUBLE * f / (SELECT count(*) FROM free WHERE NOT same) AS outside FROM (VALUES (0, 0.2::DOUBLE), (1, 0.5), (2, 0.8)) t(level, f)),
neg AS (SELECT level, source, target FROM free, q WHERE {uniform_sql("'0|negative'", "source", "target")} < CASE WHEN same THEN inside ELSE outside END)
SELECT CAST(level AS INTEGER) AS level, source, target, 1 AS sign FROM pos, q UNION ALL SELECT CAST(level AS INTEGER), source, target, -1 FROM neg""",
    "inter_community_negatives": f"WITH {VECTOR_SQL}, {LABEL_SQL} SELECT count(*) AS n_edges, count(*) FILTER (a.community <> b.community) AS n_between FROM g LEFT JOIN part a ON a.node_id = source LEFT JOIN part b ON b.node_id = target WHERE sign < 0",
}

_QUERIES = [
    unsigned_panel, signed_panel, inter_community_negatives, panel_measurements,
    signed_examples, forbidden_pairs, three_class_examples, label_histogram, endpoint_features, confusion_matrix, class_f1, f1_report, auc_rank, probe_metrics, config_grid, select_config, selected_runs, level_aggregate, spearman, final_report,
    balanced_communities, sbm_pair_pools, allocation, exact_layer, bernoulli_layer, structural_panel, prevalence_panel, signed_generator, held_out_pairs, generated_opinions, permuted_opinions, node_layout, er_panel_report,
]
WHOLE = {
    "inter_community_negatives", "signed_examples", "forbidden_pairs", "three_class_examples", "label_histogram", "endpoint_features", "confusion_matrix", "class_f1", "f1_report", "auc_rank", "probe_metrics", "level_aggregate", "spearman",
}
QUERIES = registered(_QUERIES, ORACLE, WHOLE, set())
