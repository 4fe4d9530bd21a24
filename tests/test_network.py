import pytest

import __spark_entry__ as entry
from signetry.plans import inputs

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def n_nodes(spark):
    return entry.queries()["dense_rank_ids"](spark, SF).count()


def test_network_queries_take_every_node_and_number(spark, n_nodes):
    q = entry.queries()
    report = q["polarization_report"](spark, SF).first()
    assert report["num_nodes"] == n_nodes > inputs.NODES and report["num_edges"] == q["keep_last"](spark, SF).count()
    assert q["network_gram_matrix"](spark, SF).count() == 64 * 65 // 2
    axes = q["network_l2_normalized_state"](spark, SF).groupBy("axis").count().collect()
    assert {r["axis"] for r in axes} == set(range(8)) and {r["count"] for r in axes} == {n_nodes}
    assert q["split_snapshot"](spark, SF).count() == report["num_edges"]


def test_nodes_without_a_usable_vector_stand_at_the_mean(spark, tmp_path):
    log = [(i, 10 * i, 10 * i + 10, 1.0, 5) for i in range(3)]
    spark.createDataFrame(log, "event_id bigint, source bigint, target bigint, weight double, timestamp bigint").write.parquet(f"{tmp_path}/train_events.parquet")
    vectors = [(0, [1.0] * 8), (10, [3.0] * 8), (10, [float("nan")] * 8), (20, [1.0] * 7), (99, [50.0] * 8)]
    spark.createDataFrame(vectors, "node_id bigint, opinion_coordinates array<double>").write.parquet(f"{tmp_path}/opinion_coordinates.parquet")
    rows = inputs.over_network(inputs.short_coordinates)(spark, str(tmp_path)).collect()
    assert {r["node_id"]: r["value"][0] for r in rows} == {0: 1.0, 1: 3.0, 2: 2.0, 3: 2.0}
    assert inputs._RUN.get() is None


def test_components_of_the_whole_table_and_of_a_disconnected_one(spark, n_nodes, tmp_path):
    q = entry.queries()
    assert q["network_connected_components"](spark, SF).count() == n_nodes
    assert q["sweep_communities"](spark, SF).agg({"size": "sum"}).first()[0] == n_nodes
    log = [(0, 5, 7, 1.0, 1), (1, 2, 5, -1.0, 1), (2, 11, 12, 1.0, 1)]
    spark.createDataFrame(log, "event_id bigint, source bigint, target bigint, weight double, timestamp bigint").write.parquet(f"{tmp_path}/train_events.parquet")
    labels = {r["node_id"]: r["component"] for r in q["network_connected_components"](spark, str(tmp_path)).collect()}
    assert labels == {2: 2, 5: 2, 7: 2, 11: 11, 12: 11}
    assert {(r["source"], r["target"], r["sign"]) for r in q["network_lcc_edges"](spark, str(tmp_path)).collect()} == {(0, 1, -1), (1, 2, 1)}
