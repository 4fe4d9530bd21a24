"""Queries of gray zones, candidates, greedy choice and augmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import interventions as iv
from ..session import stored
from .inputs import LABEL_SQL, NODES, STATE_SQL, VECTOR_SQL, node_count, registered, short_coordinates, vector_graph, vector_labels, vector_state

MINIMUM = 40
CAP = 200


def retained_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.retained(vector_labels(spark, sf_dir), MINIMUM)


def community_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.community_pairs(stored(retained_communities(spark, sf_dir)))


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = iv.centroids(short_coordinates(spark, sf_dir), vector_labels(spark, sf_dir))
    return rows.select("community", F.col("axis").cast("int").alias("axis"), (F.round("mean", 6) + F.lit(0.0)).alias("mean"))


def _gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.gray_ranking(short_coordinates(spark, sf_dir), vector_labels(spark, sf_dir), MINIMUM)


def gray_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gray(spark, sf_dir).withColumns({"score": F.round("score", 6), "rank": F.col("rank").cast("bigint")})


def gray_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    contexts = iv.gray_contexts(stored(_gray(spark, sf_dir)), vector_labels(spark, sf_dir))
    return contexts.groupBy("community_1", "community_2", "edge_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("source") * 1000 + F.col("target")).alias("total"))


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.candidate_pool(stored(_gray(spark, sf_dir)), vector_labels(spark, sf_dir), vector_graph(spark, sf_dir), CAP, 17)


def candidate_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pool(spark, sf_dir).withColumn("sample_rank", F.col("sample_rank").cast("bigint"))


def proposed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form for large unions, whatever the size of the union."""
    return iv.candidate_pool(stored(_gray(spark, sf_dir)), vector_labels(spark, sf_dir), vector_graph(spark, sf_dir), CAP, 17, exact=0)


def non_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.non_edges(node_count(spark, sf_dir), vector_graph(spark, sf_dir), 100, "7", strict=False).withColumn("sample_rank", F.col("sample_rank").cast("bigint"))


def augment_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = vector_graph(spark, sf_dir).withColumn("weight", F.col("sign").cast("double"))
    return iv.augment(graph, iv.non_edges(node_count(spark, sf_dir), graph, 100, "7", strict=False).select("source", "target"))


def random_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.random_baseline(vector_graph(spark, sf_dir).withColumn("weight", F.col("sign").cast("double")), node_count(spark, sf_dir), 50, strict=False)


def edge_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two sets of 100 node pairs that share 50: the first free pairs in hashed order, where these end occupied ones."""
    n = node_count(spark, sf_dir)
    pairs = iv.non_edges(n, vector_graph(spark, sf_dir), 150, "7", strict=False)
    if (free := pairs.count()) < 150:
        rest = iv.non_edges(n, pairs, 150 - free, "7")
        pairs = pairs.unionByName(rest.withColumn("sample_rank", F.col("sample_rank") + free))
    return iv.edge_jaccard(pairs.where("sample_rank <= 100"), pairs.where("sample_rank > 50")).select(F.round("jaccard", 6).alias("jaccard"))


def budget_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = [0.025, 0.05, 0.075, 0.10]
    plan = iv.budget_plan(vector_graph(spark, sf_dir).count(), rates)
    return spark.createDataFrame([(r, b, plan["candidate_cap"]) for r, b in zip(rates, plan["budgets"])], "rate double, budget bigint, candidate_cap bigint")


def _problem(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return stored(vector_graph(spark, sf_dir)), short_coordinates(spark, sf_dir), stored(_pool(spark, sf_dir))


def greedy_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, coordinates, pool = _problem(spark, sf_dir)
    return iv.greedy_order(edges, coordinates, pool, 20, node_count(spark, sf_dir))


def greedy_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, coordinates, pool = _problem(spark, sf_dir)
    return iv.prefix_energies(edges, coordinates, stored(iv.greedy_order(edges, coordinates, pool, 20, node_count(spark, sf_dir))), [5, 10, 15, 20], node_count(spark, sf_dir))


def prefiltered_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, coordinates, pool = _problem(spark, sf_dir)
    return iv.initial_prefilter(edges, coordinates, pool, 20, 50, node_count(spark, sf_dir))


def batched_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, coordinates, pool = _problem(spark, sf_dir)
    return iv.batched_greedy(edges, coordinates, pool, 20, 10, node_count(spark, sf_dir), equal=True)


def global_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.global_baseline(stored(vector_graph(spark, sf_dir)), short_coordinates(spark, sf_dir), node_count(spark, sf_dir), 200, 10)


def kmeans_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.kmeans_communities(vector_state(spark, sf_dir), 10, restarts=2).groupBy("community").agg(F.count(F.lit(1)).alias("size"))


_RET = f"ret AS (SELECT community, count(*) AS size FROM part GROUP BY community HAVING count(*) >= {MINIMUM}), pairs AS (SELECT a.community AS community_1, b.community AS community_2, a.size AS size_c1, b.size AS size_c2 FROM ret a JOIN ret b ON a.community < b.community)"
_CEN = "c4 AS (SELECT * FROM st WHERE axis < 4), cen AS (SELECT community, axis, avg(x) AS mean FROM c4 JOIN part USING (node_id) GROUP BY ALL)"
_GRAY = """dist AS (SELECT c4.node_id, cen.community, sqrt(sum((x - mean) * (x - mean))) AS d FROM c4 JOIN cen USING (axis) GROUP BY ALL),
scored AS (SELECT community_1, community_2, p.node_id, abs(l.d - r.d) + greatest(l.d, r.d) AS score FROM pairs JOIN part p ON p.community NOT IN (community_1, community_2)
  JOIN dist l ON l.node_id = p.node_id AND l.community = community_1 JOIN dist r ON r.node_id = p.node_id AND r.community = community_2),
gray AS (SELECT *, row_number() OVER (PARTITION BY community_1, community_2 ORDER BY round(score, 9), node_id) AS rank FROM scored QUALIFY rank <= (SELECT ceil(avg(size)) FROM ret))"""
_CTX = """ctx AS (SELECT a.node_id AS source, b.node_id AS target, community_1, community_2, 'gray_gray' AS edge_type FROM gray a JOIN gray b USING (community_1, community_2) WHERE a.node_id < b.node_id
 UNION SELECT least(a.node_id, p.node_id), greatest(a.node_id, p.node_id), community_1, community_2, 'community_1_gray' FROM gray a JOIN part p ON p.community = community_1 WHERE a.node_id <> p.node_id
 UNION SELECT least(a.node_id, p.node_id), greatest(a.node_id, p.node_id), community_1, community_2, 'gray_community_2' FROM gray a JOIN part p ON p.community = community_2 WHERE a.node_id <> p.node_id)"""
_BASE = f"{LABEL_SQL}, {STATE_SQL}, {_RET}, {_CEN}, {_GRAY}"
_FREE = f"free AS (SELECT a.range AS source, b.range AS target FROM range({NODES}) a, range({NODES}) b WHERE a.range < b.range AND NOT EXISTS (SELECT 1 FROM g WHERE g.source = a.range AND g.target = b.range))"


def _none(seed: str, count: int) -> str:
    return f"SELECT source, target, row_number() OVER (ORDER BY md5(concat_ws('|', '{seed}', source, target)), source, target) AS sample_rank FROM free QUALIFY sample_rank <= {count}"


ORACLE = {
    "retained_communities": f"WITH {LABEL_SQL}, {_RET} SELECT community, size FROM ret",
    "community_pairs": f"WITH {LABEL_SQL}, {_RET} SELECT * FROM pairs",
    "centroids": f"WITH {LABEL_SQL}, {STATE_SQL}, {_CEN} SELECT community, axis, round(mean, 6) + 0.0 AS mean FROM cen",
    "gray_ranking": f"WITH {_BASE} SELECT community_1, community_2, node_id, round(score, 6) AS score, rank FROM gray",
    "gray_union": f"WITH {_BASE}, {_CTX} SELECT community_1, community_2, edge_type, count(*) AS n, CAST(sum(source * 1000 + target) AS BIGINT) AS total FROM ctx GROUP BY ALL",
    "candidate_sample": f"""WITH {_BASE}, {_CTX}, {VECTOR_SQL}, one AS (SELECT * FROM ctx QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY md5(concat_ws('|', '17|context', source, target, community_1, community_2, edge_type))) = 1)
SELECT one.source, one.target, community_1, community_2, edge_type, row_number() OVER (ORDER BY md5(concat_ws('|', '17', one.source, one.target)), one.source, one.target) AS sample_rank
FROM one LEFT JOIN g USING (source, target) WHERE g.sign IS NULL QUALIFY sample_rank <= {CAP}""",
    "non_edges": f"WITH {VECTOR_SQL}, {_FREE} {_none('7', 100)}",
    "augment_edges": f"WITH {VECTOR_SQL}, {_FREE}, n AS ({_none('7', 100)}) SELECT source, target, CAST(sign AS INTEGER) AS sign, CAST(sign AS DOUBLE) AS weight FROM g UNION ALL SELECT source, target, 1, 1.0 FROM n",
    "random_baseline": f"WITH {VECTOR_SQL}, {_FREE}, n AS ({_none('0|2026|50', 50)}) SELECT source, target, CAST(sign AS INTEGER) AS sign, CAST(sign AS DOUBLE) AS weight FROM g UNION ALL SELECT source, target, 1, 1.0 FROM n",
    "edge_jaccard": "SELECT round(50.0::DOUBLE / 150.0, 6) AS jaccard",
    "budget_plan": f"""WITH {VECTOR_SQL}, n AS (SELECT count(*) AS n FROM g), r AS (SELECT unnest([0.025, 0.05, 0.075, 0.1])::DOUBLE AS rate)
SELECT rate, CAST(greatest(1, floor(rate * n)) AS BIGINT) AS budget, CAST(20 * greatest(1, floor(0.1::DOUBLE * n)) AS BIGINT) AS candidate_cap FROM r, n""",
}

_QUERIES = [
    retained_communities, community_pairs, centroids, gray_ranking, gray_union, candidate_sample, proposed_candidates, non_edges, augment_edges, random_baseline, edge_jaccard, budget_plan, prefiltered_candidates, greedy_order, greedy_curve, batched_greedy, global_baseline,
    kmeans_communities,
]
WHOLE = {
    "retained_communities", "community_pairs", "centroids", "gray_ranking", "candidate_sample", "proposed_candidates", "non_edges", "augment_edges", "random_baseline", "edge_jaccard", "budget_plan", "kmeans_communities",
}
CONNECTED = {"greedy_order", "greedy_curve", "batched_greedy", "global_baseline"}
QUERIES = registered(_QUERIES, ORACLE, WHOLE, CONNECTED)
