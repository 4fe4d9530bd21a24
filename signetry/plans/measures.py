"""Queries of linear algebra, polarization and communities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import l2_normalized
from ..operators import communities, encoders, laplacian, polarization
from ..operators.components import largest_component
from ..operators.events import apply_ids, sorted_ids
from ..session import stored
from .inputs import EVENTS_SQL, LABEL_SQL, STATE_SQL, VECTOR_SQL, node_count, rating_graph, registered, short_coordinates, vector_graph, vector_labels, vector_state


def _long(values: DataFrame, name: str = "value") -> DataFrame:
    return values.select("node_id", F.posexplode(name).alias("axis", "x")).select("node_id", F.col("axis").cast("int").alias("axis"), (F.round("x", 6) + F.lit(0.0)).alias("x"))


def centered_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = vector_state(spark, sf_dir).select("node_id", F.posexplode("state").alias("axis", "x"))
    means = long.groupBy("axis").agg(F.avg("x").alias("m"))  # as many rows as the vectors have places
    return long.join(F.broadcast(means), "axis").select("node_id", F.col("axis").cast("int").alias("axis"), (F.round(F.col("x") - F.col("m"), 6) + F.lit(0.0)).alias("x"))


def gram_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polarization.gram(vector_state(spark, sf_dir)).where("i >= 0").select("i", "j", (F.round("total", 6) + F.lit(0.0)).alias("total"))


def l2_normalized_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(short_coordinates(spark, sf_dir).select("node_id", l2_normalized(F.col("value")).alias("value")))


def antagonistic_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(polarization.antagonistic_signal(vector_graph(spark, sf_dir), short_coordinates(spark, sf_dir)))


def laplacian_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(laplacian.spread_values(laplacian.weighted_edges(vector_graph(spark, sf_dir)), short_coordinates(spark, sf_dir)))


def quadratic_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polarization.dirichlet_energy(vector_graph(spark, sf_dir), short_coordinates(spark, sf_dir)).select(F.round("energy", 4).alias("energy"))


def solver_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the solvers for larger graphs give what the factored matrix gives.

    Some axes at a time are solved on the driver; solvers that are the same at this size solve once.
    """
    edges = stored(laplacian.weighted_edges(vector_graph(spark, sf_dir)))
    values = stored(short_coordinates(spark, sf_dir))
    n = node_count(spark, sf_dir)
    dense = laplacian.Solver(edges, n)
    held = dense if dense.matrix is None else laplacian.Solver(edges, n, dense=0)
    sent = laplacian.Solver(edges, n, dense=0, held=0) if held.held else held
    solved = laplacian.solve_table(edges, values)
    width = values.select(F.max(F.size("value"))).first()[0]
    some = max(1, 2 * laplacian.AT_ONCE // n)
    gaps = dict.fromkeys(("held", "sent", "table"), 0.0)
    for at in range(0, width, some):
        own = F.slice("value", at + 1, some).alias("value")
        x = laplacian.held_values(values.select("node_id", own), n)
        x -= x.mean(0)
        plain = dense.solve(x)
        for name, solver in (("held", held), ("sent", sent)):
            if solver is not dense:
                gaps[name] = np.maximum(gaps[name], np.abs(plain - solver.solve(x)).max())  # keeps NaN
        del x
        other = laplacian.held_values(solved.select("node_id", own), n)
        other -= other.mean(0)
        other -= plain
        gaps["table"] = np.maximum(gaps["table"], np.abs(other).max())
    return spark.createDataFrame([(k, bool(gap < 1e-5)) for k, gap in gaps.items()], "solver string, agrees boolean")


def _connected(spark: SparkSession, sf_dir: str, positive: bool = False) -> tuple[DataFrame, DataFrame]:
    """The largest component (of the positive layer) of the vector graph and its nodes' states, numbered from 0."""
    graph = stored(vector_graph(spark, sf_dir))
    ids = stored(sorted_ids(largest_component(graph.where("sign > 0") if positive else graph)))
    state = vector_state(spark, sf_dir).withColumnRenamed("node_id", "raw_id").join(ids, "raw_id").select("node_id", "state")
    return stored(apply_ids(graph, ids)), stored(state)


def polarization_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of given coordinates over the largest component: both energies by solving the Laplacian's systems."""
    graph = stored(vector_graph(spark, sf_dir))
    ids = stored(sorted_ids(largest_component(graph)))
    values = stored(short_coordinates(spark, sf_dir).withColumnRenamed("node_id", "raw_id").join(ids, "raw_id").select("node_id", "value"))
    record = polarization.energy_components(stored(apply_ids(graph, ids)), values, ids.count(), checked=True)
    whole = ["num_nodes", "num_edges", "positive_edges", "negative_edges"]
    rounded = ["structural_energy", "antagonistic_energy", "structural_score", "polarization"]
    return spark.createDataFrame([tuple([record[c] for c in whole] + [round(record[c], 5) for c in rounded])], ", ".join([f"{c} bigint" for c in whole] + [f"{c} double" for c in rounded]))


def er_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline over the positive layer for the first coordinate as opinion."""
    opinions = short_coordinates(spark, sf_dir).select("node_id", F.col("value")[0].alias("opinion"))
    score = polarization.er_baseline(stored(vector_graph(spark, sf_dir)), opinions, node_count(spark, sf_dir))
    return spark.createDataFrame([(round(score, 5),)], "er_polarization double")


def polarization_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, state = _connected(spark, sf_dir)
    return polarization.measure(edges, state, 2, checked=True).unionByName(polarization.measure(edges, state, 8, checked=True))


def sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, state = _connected(spark, sf_dir)
    return polarization.sensitivity(edges, state, 8, checked=True)


def er_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, state = _connected(spark, sf_dir, positive=True)
    opinions = state.select("node_id", F.col("state")[0].alias("opinion"))
    score = polarization.er_baseline(edges, opinions, state.count())
    return spark.createDataFrame([(score,)], "er_polarization double")


def tsvd_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, values = encoders.spectral_features(vector_graph(spark, sf_dir), node_count(spark, sf_dir), 8)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "rank int, singular_value double").join(state.agg(F.count(F.lit(1)).alias("n_nodes")), how="cross")


def signed_neighbor_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encoders.signed_neighbour_mean(vector_graph(spark, sf_dir), short_coordinates(spark, sf_dir).withColumnRenamed("value", "state"))
    return rows.select("node_id", "sign", F.col("axis").cast("int").alias("axis"), (F.round("mean", 6) + F.lit(0.0)).alias("mean"))


def encoder_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = encoders.EncoderConfig(input_dimension=8, output_dimension=8, epochs=20)
    features = short_coordinates(spark, sf_dir).select("node_id", F.slice(F.concat("value", "value"), 1, 8).alias("state"))
    return encoders.UndirectedSigned().trained_states(vector_graph(spark, sf_dir), features, config, [0, 1])


# ---------------------------------------------------------------------------------- communities
def signed_modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = communities.layered(vector_graph(spark, sf_dir))
    return communities.modularity(layers, vector_labels(spark, sf_dir)).select(F.round("modularity", 6).alias("modularity"))


def community_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities.community_layers(communities.layered(vector_graph(spark, sf_dir)), vector_labels(spark, sf_dir))


def community_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_labels(spark, sf_dir).groupBy("community").agg(F.count(F.lit(1)).alias("size"))


def packed_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities.packed_communities(vector_labels(spark, sf_dir))


def candidate_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities.candidate_communities(vector_graph(spark, sf_dir), vector_labels(spark, sf_dir))


def move_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    gains = communities.move_gains(vector_graph(spark, sf_dir), vector_labels(spark, sf_dir))
    return gains.select("node_id", "community", (F.round("gain", 6) + F.lit(0.0)).alias("gain"))


def induced_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities.induced_graph(communities.layered(vector_graph(spark, sf_dir)), vector_labels(spark, sf_dir))


def flatten_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = vector_labels(spark, sf_dir)
    high = low.select(F.col("community").alias("node_id")).distinct().withColumn("community", F.col("node_id") % 3)
    return communities.flatten([low, high])


def renumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = vector_labels(spark, sf_dir).withColumn("community", F.col("community") * 7 + 3)
    return communities.renumbered(odd)


def mode_first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [9, 9, 8, 8, 7, 7, 7, 7, 9, 9]
    return communities.mode_first(spark.createDataFrame(list(enumerate(counts)), "position int, n int"))


def louvain_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities.estimate_k(vector_graph(spark, sf_dir), 5, [0, 1, 2])


def louvain_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = communities.louvain_runs(vector_graph(spark, sf_dir), [0, 1])
    return runs.groupBy("seed", "community").agg(F.count(F.lit(1)).alias("size"), F.max("modularity").alias("modularity"))


def sweep_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = stored(rating_graph(spark, sf_dir))
    nodes = edges.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()
    return communities.sweep_communities(edges, nodes).groupBy("community").agg(F.count(F.lit(1)).alias("size"))


def rating_degrees_by_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities.layer_degrees(communities.layered(rating_graph(spark, sf_dir)))


_BOTH = "both_ AS (SELECT source, target, sign FROM g UNION ALL SELECT target, source, sign FROM g)"
_COND = "CASE WHEN sign > 0 THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END"
_SHORT = "c4 AS (SELECT * FROM st WHERE axis < 4)"
_LAY = "lay AS (SELECT source, target, CASE WHEN sign > 0 THEN 'positive' ELSE 'negative' END AS layer, 1.0::DOUBLE AS weight FROM g), dbl AS (SELECT source, target, layer, weight FROM lay UNION ALL SELECT target, source, layer, weight FROM lay), tot AS (SELECT layer, sum(weight) AS m FROM lay GROUP BY layer), deg AS (SELECT source AS node_id, layer, sum(weight) AS degree FROM dbl GROUP BY ALL)"
_COM = """com AS (SELECT community, layer, sum(degree) AS degree FROM deg JOIN part USING (node_id) GROUP BY ALL),
inn AS (SELECT a.community, layer, sum(weight) AS internal FROM lay JOIN part a ON a.node_id = source JOIN part b ON b.node_id = target WHERE a.community = b.community GROUP BY ALL),
cl AS (SELECT community, layer, degree, coalesce(internal, 0.0) AS internal FROM com LEFT JOIN inn USING (community, layer))"""
_NEAR = """neg AS (SELECT DISTINCT source, target FROM both_ WHERE sign < 0), near AS (SELECT source AS node_id, target AS other FROM both_ UNION SELECT a.source, b.target FROM neg a JOIN neg b ON a.target = b.source WHERE a.source <> b.target),
cand AS (SELECT near.node_id, community FROM near JOIN part ON part.node_id = other UNION SELECT node_id, community FROM part)"""

ORACLE = {
    "centered_state": f"WITH {STATE_SQL} SELECT node_id, axis, round(x - avg(x) OVER (PARTITION BY axis), 6) + 0.0 AS x FROM st",
    "gram_matrix": f"WITH {STATE_SQL} SELECT a.axis AS i, b.axis AS j, round(sum(a.x * b.x), 6) + 0.0 AS total FROM st a JOIN st b ON a.node_id = b.node_id AND a.axis <= b.axis GROUP BY ALL",
    "l2_normalized_state": f"WITH {STATE_SQL}, {_SHORT} SELECT node_id, axis, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY node_id)), 1e-12), 6) + 0.0 AS x FROM c4",
    "antagonistic_signal": f"""WITH {STATE_SQL}, {_SHORT}, {VECTOR_SQL}, {_BOTH}, p AS (SELECT b.source AS node_id, s.axis, sum(s.x - t.x) AS x FROM both_ b JOIN c4 s ON s.node_id = b.source JOIN c4 t ON t.node_id = b.target AND t.axis = s.axis WHERE sign < 0 GROUP BY ALL)
SELECT node_id, axis, round(coalesce(p.x, 0), 6) + 0.0 AS x FROM c4 LEFT JOIN p USING (node_id, axis)""",
    "laplacian_product": f"""WITH {STATE_SQL}, {_SHORT}, {VECTOR_SQL}, {_BOTH} SELECT b.source AS node_id, s.axis, round(sum({_COND} * (s.x - t.x)), 6) + 0.0 AS x
FROM both_ b JOIN c4 s ON s.node_id = b.source JOIN c4 t ON t.node_id = b.target AND t.axis = s.axis GROUP BY ALL""",
    "quadratic_form": f"WITH {STATE_SQL}, {_SHORT}, {VECTOR_SQL} SELECT round(sum({_COND} * (s.x - t.x) * (s.x - t.x)) / 4, 4) AS energy FROM g JOIN c4 s ON s.node_id = source JOIN c4 t ON t.node_id = target AND t.axis = s.axis",
    "solver_residual": "SELECT unnest(['held', 'sent', 'table']) AS solver, true AS agrees",
    "signed_neighbor_mean": f"WITH {STATE_SQL}, {_SHORT}, {VECTOR_SQL}, {_BOTH} SELECT b.source AS node_id, CAST(b.sign AS INTEGER) AS sign, axis, round(avg(x), 6) + 0.0 AS mean FROM both_ b JOIN c4 ON c4.node_id = b.target GROUP BY ALL",
    "signed_modularity": f"""WITH {VECTOR_SQL}, {LABEL_SQL}, {_LAY}, {_COM}
SELECT round(sum(CASE WHEN layer = 'positive' THEN 1 ELSE -1 END * (internal / m - (degree / (2 * m)) * (degree / (2 * m)))), 6) AS modularity FROM cl JOIN tot USING (layer)""",
    "community_layers": f"WITH {VECTOR_SQL}, {LABEL_SQL}, {_LAY}, {_COM} SELECT community, layer, degree, internal::DOUBLE AS internal FROM cl",
    "community_sizes": f"WITH {LABEL_SQL} SELECT community, count(*) AS size FROM part GROUP BY community",
    "packed_communities": f"WITH {LABEL_SQL} SELECT community AS community_id, string_agg(CAST(node_id AS VARCHAR), ',' ORDER BY node_id) AS nodes, count(*) AS size FROM part GROUP BY community",
    "candidate_communities": f"WITH {VECTOR_SQL}, {LABEL_SQL}, {_BOTH}, {_NEAR} SELECT DISTINCT node_id, community FROM cand",
    "move_gain": f"""WITH {VECTOR_SQL}, {LABEL_SQL}, {_BOTH}, {_NEAR}, {_LAY}, {_COM},
w AS (SELECT source AS node_id, community, layer, sum(weight) AS w FROM dbl JOIN part ON part.node_id = target GROUP BY ALL),
x AS (SELECT c.node_id, c.community, h.community AS home, d.layer, d.degree AS d, m, coalesce(t.degree, 0) - CASE WHEN c.community = h.community THEN d.degree ELSE 0 END AS there, coalesce(w.w, 0) AS w, ht.degree - d.degree AS home_rest, coalesce(hw.w, 0) AS home_w
  FROM (SELECT DISTINCT * FROM cand) c JOIN part h ON h.node_id = c.node_id JOIN deg d ON d.node_id = c.node_id JOIN tot USING (layer)
  LEFT JOIN com t ON t.community = c.community AND t.layer = d.layer LEFT JOIN w ON w.node_id = c.node_id AND w.community = c.community AND w.layer = d.layer
  JOIN com ht ON ht.community = h.community AND ht.layer = d.layer LEFT JOIN w hw ON hw.node_id = c.node_id AND hw.community = h.community AND hw.layer = d.layer)
SELECT node_id, community, round(sum(CASE WHEN layer = 'positive' THEN 1 ELSE -1 END * (w - there * d / (2 * m) + home_rest * d / (2 * m) - home_w)), 6) + 0.0 AS gain FROM x GROUP BY node_id, community""",
    "induced_graph": f"""WITH {VECTOR_SQL}, {LABEL_SQL}, {_LAY} SELECT least(a.community, b.community) AS source, greatest(a.community, b.community) AS target, layer, sum(weight) AS weight
FROM lay JOIN part a ON a.node_id = source JOIN part b ON b.node_id = target GROUP BY ALL""",
    "flatten_levels": f"WITH {LABEL_SQL} SELECT node_id, CAST(community % 3 AS INTEGER) AS community FROM part",
    "renumbered": f"WITH {LABEL_SQL} SELECT node_id, dense_rank() OVER (ORDER BY community) - 1 AS community FROM part",
    "mode_first_occurrence": "SELECT 9::INTEGER AS n, 4::BIGINT AS times",
    "rating_degrees_by_layer": f"""WITH {EVENTS_SQL}, b AS (SELECT source, sign FROM phys UNION ALL SELECT target, sign FROM phys)
SELECT source AS node_id, CASE WHEN sign > 0 THEN 'positive' ELSE 'negative' END AS layer, count(*)::DOUBLE AS degree FROM b GROUP BY ALL""",
}

def _solved(conductance: str, signals: str, rounds: int = 120) -> str:
    """SQL that solves the systems of a connected Laplacian by rounds of x <- x + (b - L x) / d, as ``energy`` per kind."""
    return f"""e AS (SELECT source, target, {conductance} AS c FROM both_), deg AS (SELECT source AS node_id, sum(c) AS d FROM e GROUP BY source),
m AS MATERIALIZED (SELECT source, target, c / d AS w FROM e JOIN deg ON node_id = source), sig AS ({signals}),
b AS (SELECT kind, axis, node_id, x - avg(x) OVER (PARTITION BY kind, axis) AS b FROM sig), bd AS MATERIALIZED (SELECT kind, axis, node_id, b / d AS x FROM b JOIN deg USING (node_id)),
it(k, kind, axis, node_id, x) AS (SELECT 0, kind, axis, node_id, x FROM bd
  UNION ALL SELECT it.k + 1, it.kind, it.axis, m.source, sum(m.w * it.x) + any_value(bd.x) FROM it JOIN m ON m.target = it.node_id JOIN bd ON bd.kind = it.kind AND bd.axis = it.axis AND bd.node_id = m.source
  WHERE it.k < {rounds} GROUP BY it.k, it.kind, it.axis, m.source),
energy AS (SELECT kind, sum(b.b * it.x) / count(DISTINCT axis) AS energy FROM it JOIN b USING (kind, axis, node_id) WHERE k = {rounds} GROUP BY kind)"""


_PULL = "SELECT 'y' AS kind, axis, node_id, coalesce(p.x, 0) AS x FROM c4 LEFT JOIN (SELECT b.source AS node_id, s.axis, sum(s.x - t.x) AS x FROM both_ b JOIN c4 s ON s.node_id = b.source JOIN c4 t ON t.node_id = b.target AND t.axis = s.axis WHERE b.sign < 0 GROUP BY ALL) p USING (node_id, axis)"
ORACLE |= {
    "polarization_score": f"""WITH RECURSIVE {STATE_SQL}, {_SHORT}, {VECTOR_SQL}, {_BOTH}, {_solved(_COND, "SELECT 'z' AS kind, axis, node_id, x FROM c4 UNION ALL " + _PULL)},
two AS (SELECT max(energy) FILTER (kind = 'z') AS z, max(energy) FILTER (kind = 'y') AS y FROM energy)
SELECT (SELECT count(DISTINCT node_id) FROM c4) AS num_nodes, (SELECT count(*) FROM g) AS num_edges, (SELECT count(*) FROM g WHERE sign > 0) AS positive_edges, (SELECT count(*) FROM g WHERE sign < 0) AS negative_edges,
  round(z, 5) AS structural_energy, round(y, 5) AS antagonistic_energy, round(sqrt(z), 5) AS structural_score, round(sqrt(z + 0.05::DOUBLE * y), 5) AS polarization FROM two""",
    "er_score": f"""WITH RECURSIVE {STATE_SQL}, {_SHORT}, {VECTOR_SQL}, both_ AS (SELECT source, target FROM g WHERE sign > 0 UNION ALL SELECT target, source FROM g WHERE sign > 0),
{_solved("1.0::DOUBLE", "SELECT 'o' AS kind, axis, node_id, x FROM c4 WHERE axis = 0")} SELECT round(sqrt(energy), 5) AS er_polarization FROM energy""",
}

_QUERIES = [
    polarization_score, er_score,
    centered_state, gram_matrix, l2_normalized_state, antagonistic_signal, laplacian_product, quadratic_form, solver_residual, polarization_report, sensitivity, er_baseline, tsvd_features, signed_neighbor_mean, encoder_states,
    signed_modularity, community_layers, community_sizes, packed_communities, candidate_communities, move_gain, induced_graph, flatten_levels, renumbered, mode_first_occurrence, louvain_k, louvain_runs, sweep_communities, rating_degrees_by_layer,
]
WHOLE = {
    "centered_state", "gram_matrix", "l2_normalized_state", "antagonistic_signal", "laplacian_product", "quadratic_form", "tsvd_features", "signed_neighbor_mean", "encoder_states", "signed_modularity", "community_layers", "community_sizes", "packed_communities", "candidate_communities", "move_gain", "induced_graph", "flatten_levels", "renumbered", "louvain_k", "louvain_runs", "polarization_report", "sensitivity", "er_baseline",
}
CONNECTED = {"solver_residual", "polarization_score"}
QUERIES = registered(_QUERIES, ORACLE, WHOLE, CONNECTED)
