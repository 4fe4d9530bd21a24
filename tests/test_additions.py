import numpy as np
import pytest

from signetry import pipeline, session
from signetry.operators import interventions as iv
from signetry.operators import synthetic
from signetry.operators.encoders import EncoderConfig
from signetry.operators.laplacian import Solver, _lower_inverse, weighted_edges
from signetry.sources.readers import read_npy, read_npz
from signetry.streaming.keep_last import read_parquet, start_parquet, streaming_latest

EDGES = "source bigint, target bigint, sign int"


def test_numpy_files(spark, tmp_path, rows):
    a = np.arange(12.0).reshape(4, 3)
    np.save(tmp_path / "a.npy", a)
    np.savez(tmp_path / "b.npz", weight=a, bias=np.array([1.5]))
    got = read_npy(spark, f"{tmp_path}/a.npy", chunk=3).collect()
    assert {r["node_id"]: list(r["state"]) for r in got} == {i: list(a[i]) for i in range(4)}
    assert rows(read_npz(spark, f"{tmp_path}/b.npz")) == [("bias", [1], [1.5]), ("weight", [4, 3], list(map(float, range(12))))]
    np.save(tmp_path / "o.npy", np.array([{}], dtype=object))
    with pytest.raises(Exception, match="(?i)pickle"):
        read_npy(spark, f"{tmp_path}/o.npy").collect()


def test_inverse_by_halves():
    r = np.random.default_rng(0)
    a = r.standard_normal((150, 150))
    lower = np.linalg.cholesky(a @ a.T + 150 * np.eye(150))
    assert np.abs(_lower_inverse(lower) @ lower - np.eye(150)).max() < 1e-10


def test_one_factor_serves_many_systems(spark):
    edges = spark.createDataFrame([(i, (i + 1) % 7, 1) for i in range(7)] + [(0, 3, -1)], EDGES)
    for grounded in (True, False):
        solver = Solver(weighted_edges(edges), 7, grounded=grounded)
        for seed in range(2):
            b = np.random.default_rng(seed).standard_normal((7, 2))
            b -= b.mean(0)
            x = solver.solve(b)
            assert np.abs((solver.matrix @ x - b)[:-1]).max() < 1e-9


def test_non_edges_of_large_dense_graphs(spark):
    n = 40
    taken = [(i, j, 1) for i in range(n) for j in range(i + 1, n) if (i, j) not in {(0, 1), (2, 3), (10, 30)}]
    dense = spark.createDataFrame(taken, EDGES)
    out = iv.non_edges(n, dense, 3, "s", small=5)
    assert {(r["source"], r["target"]) for r in out.collect()} == {(0, 1), (2, 3), (10, 30)}
    with pytest.raises(ValueError, match="3 of 4"):
        iv.non_edges(n, dense, 4, "s", small=5)


def test_prefilter_keeps_the_greatest_gains(spark):
    edges = spark.createDataFrame([(i, i + 1, 1) for i in range(9)], EDGES)
    values = spark.createDataFrame([(i, [float(i < 5) * 2 - 1]) for i in range(10)], "node_id bigint, value array<double>")
    pool = spark.createDataFrame([(0, 9, 1), (0, 2, 2), (1, 8, 3), (5, 7, 4)], "source bigint, target bigint, sample_rank int")
    assert iv.initial_prefilter(edges, values, pool, 1, 9, 10).count() == 4
    assert {(r["source"], r["target"]) for r in iv.initial_prefilter(edges, values, pool, 2, 2, 10).collect()} == {(0, 9), (1, 8)}
    with pytest.raises(ValueError):
        iv.initial_prefilter(edges, values, pool, 3, 2, 10)


def test_panels_keep_their_expected_numbers(spark):
    panel = synthetic.unsigned_panel(spark, 60, 3, 400.0, [0.05, 0.15])
    counts = {r["level"]: r["count"] for r in panel.groupBy("level").count().collect()}
    assert all(320 < counts[k] < 480 for k in (0, 1))
    nodes = synthetic.balanced_communities(spark, 60, 3)
    pools = session.stored(synthetic.pair_pools(nodes))
    positive = panel.where("level = 0").select("source", "target")
    signed = session.stored(synthetic.signed_panel(positive, pools, 120.0, [0.1, 0.9]))
    share = []
    for level in (0, 1):
        edges = signed.where(f"level = {level}")
        assert edges.groupBy("source", "target").count().where("count > 1").isEmpty()
        row = synthetic.inter_community_edges(edges, nodes).first()
        share.append(row["n_between"] / row["n_edges"])
    assert share[0] < 0.25 and share[1] > 0.75


def test_a_measured_panel_is_taken_up_again(spark, monkeypatch):
    panel = session.stored(synthetic.structural_panel(spark, 30, 3, 150, 40, [0.7], [0.7]))
    config = EncoderConfig(4, 4, 1, 0.02, 5)
    first = session.stored(pipeline.panel_measurements(panel, 30, 2, [0], config=config))
    monkeypatch.setattr(pipeline, "train_state", lambda *a, **k: 1 / 0)
    assert pipeline.panel_measurements(panel, 30, 2, [0], config=config, done=first).collect() == first.collect()
    with pytest.raises(ZeroDivisionError):
        pipeline.panel_measurements(panel, 30, 2, [1], config=config, done=first)


def test_the_stream_rewrites_only_what_changes(spark, tmp_path, rows):
    schema = "event_id bigint, source bigint, target bigint, sign int, ts bigint"
    source, table, checkpoint = (f"{tmp_path}/{k}" for k in ("in", "table", "checkpoint"))

    def batch(*events):
        spark.createDataFrame(list(events), schema).coalesce(1).write.mode("append").parquet(source)
        log = spark.readStream.schema(schema).parquet(source)
        start_parquet(streaming_latest(log, ["ts", "event_id"], "sign"), table, checkpoint, buckets=4).awaitTermination()
        return rows(read_parquet(spark, table).select("source", "target", "sign"))

    assert batch((1, 1, 2, 1, 10), (2, 3, 4, 1, 10), (3, 2, 1, -1, 11)) == [(1, 2, -1), (3, 4, 1)]
    assert batch((4, 4, 3, -1, 12), (5, 5, 6, 1, 1), (6, 1, 2, 1, 5)) == [(1, 2, -1), (3, 4, -1), (5, 6, 1)]


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch):
    class Context:
        applicationId, master = "none-such", "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_root(Session())
