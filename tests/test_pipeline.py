import random

import pytest
from pyspark.sql import functions as F

from signetry import pipeline
from signetry.operators import learning, synthetic
from signetry.operators.encoders import EncoderConfig
from signetry.plans import catalogue
from signetry.sources import artifacts, readers
from signetry.streaming.keep_last import start_memory, streaming_latest

PAIRS = "source bigint, target bigint, sign int"
TRAIN, VAL, TEST = [(0, 1, 1), (1, 2, -1), (2, 3, 1)], [(0, 2, -1)], [(0, 3, 1)]


def _history(spark):
    return [spark.createDataFrame(x, PAIRS) for x in (TRAIN, VAL, TEST)]


def _none(examples, split):
    return {(r["source"], r["target"]) for r in examples.where((F.col("split") == split) & (F.col("label") == 2)).collect()}


def test_non_edges_avoid_the_history_and_survive_augmentation(spark):
    train, val, test = _history(spark)
    plain = learning.three_class_examples(train, train, val, test, 6)
    more = train.unionByName(spark.createDataFrame([(4, 5, 1)], PAIRS))
    augmented = learning.three_class_examples(train, more, val, test, 6)
    for split in ("val", "test"):
        assert _none(plain, split) == _none(augmented, split) and len(_none(plain, split)) == 1
    assert not _none(plain, "test") & {(s, t) for s, t, _ in TRAIN + VAL + TEST}
    two = learning.two_class_examples(train, val, test)
    assert [r["label"] for r in two.where("split = 'train'").orderBy("source").collect()] == [1, 0, 1]


def test_the_mean_decides_and_incomplete_configurations_are_out(spark):
    rows = [(s, lr, f) for lr, fs in ((0.1, (0.9, 0.4, 0.4)), (0.2, (0.7, 0.7, 0.7)), (0.3, (0.99, 0.99))) for s, f in enumerate(fs)]
    runs = spark.createDataFrame(rows, "seed int, learning_rate double, validation_macro_f1 double")
    best = learning.select_configuration(runs)
    assert best.first()["learning_rate"] == 0.2 and learning.runs_of(runs, best).count() == 3


def test_scores_by_hand(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "label int, score double")
    assert learning.auc(df).first()[0] == pytest.approx((0.5 + 1 + 0 + 1) / 4)
    assert learning.auc(df.where("label = 1")).first()[0] is None
    predicted = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "label int, prediction int")
    report = learning.f1_report(learning.confusion(predicted, [0, 1, 2])).first()
    assert report["accuracy"] == pytest.approx(2 / 3) and report["macro_f1"] == pytest.approx(2 / 3)


def test_probe_separates_what_can_be_separated(spark):
    rows = spark.createDataFrame([(i % 2, [float(i % 2) * 4 - 2 + 0.1 * (i % 5), 1.0]) for i in range(60)], "label int, features array<double>")
    assert learning.probe_metrics(rows, rows, [0, 1]).first()["auc"] == 1.0


# ---------------------------------------------------------------------------------- readers and sinks
def test_readers_of_all_formats(spark, tmp_path):
    def read(name, text, fmt, encoding="utf-8"):
        (tmp_path / name).write_bytes(text.encode(encoding))
        return [r.asDict() for r in readers.read_raw(spark, str(tmp_path / name), fmt).orderBy("line_no").collect()]

    rows = read("a.csv", "1,2,3,1000.5\n2,3,0,5\n3,,1,5\nx,y,-2,7\n", "rating_csv")
    assert [(r["source"], r["target"], r["weight"], r["timestamp"]) for r in rows] == [("1", "2", 3.0, 1000.5), ("x", "y", -2.0, 7.0)]
    rows = read("b.txt", "V\t1\t9\t2004-01-01 00:00:00\nU\t7\tJosé\nV\t1\t3\t2004-01-01 00:00:10\nV\t0\t3\t2004-01-01 00:00:10\nV\t-1\t4\tbad\nV\t1\nU\t8\nV\t-1\t5\t2004-01-01 00:01:00\n", "vote_blocks", "latin-1")
    assert [(r["source"], r["target"], r["weight"], r["timestamp"]) for r in rows] == [("3", "7", 1.0, 1072915210), ("5", "8", -1.0, 1072915260)]
    text = "SRC:a\nTGT:b\nVOT:1\nYEA:2013\nDAT:\n\nSRC:c\nTGT:d\nVOT:0\nDAT:00:10, 1 January 2013\n\nSRC:e\nTGT:f\nVOT:-1\nDAT:00:00, 1 January 2013\n\nSRC:g\nTGT:h\nVOT:1\nDAT:00:05, 1 January 2013\n\nSRC:i\nTGT:j\nVOT:1\nDAT:nonsense"
    rows = read("c.txt", text, "key_value")
    assert [(r["source"], r["timestamp"] - 1356998400) for r in rows] == [("a", 0), ("e", 1), ("g", 300), ("i", 301)]
    rows = read("d.txt", "# head\n1\t2\t1\n2 2 1\n3 4 0\n4  3 -1\n", "edge_list")
    assert [(r["source"], r["target"], r["weight"]) for r in rows] == [(1, 2, 1.0), (4, 3, -1.0)]
    assert readers.checksums(spark, str(tmp_path / "d.txt")).count() == 1
    with pytest.raises(ValueError):
        readers.check_checksum(spark, str(tmp_path / "d.txt"), "0")
    assert readers.resolve_dataset("ra") == ["ratings_a"] and len(readers.resolve_dataset("all")) == 6


def test_dataset_round_trip_and_guards(spark, tmp_path):
    r = random.Random(5)
    raw = spark.createDataFrame([(i, str(r.randint(0, 25)), str(r.randint(0, 25)), float(r.choice([1, 2, -3])), i) for i in range(400)], "line_no bigint, source string, target string, weight double, timestamp bigint")
    done = pipeline.preprocess(raw, temporal=True)
    path = f"file://{tmp_path}/set"
    manifest = artifacts.write_dataset(done.splits, done.events, done.mapping, path, ["event_id"])
    back = readers.Splits.load(spark, path, read_test=False)
    assert back.num_nodes == done.num_nodes == manifest["counts"]["num_nodes"] and back.test.count() == 0
    assert back.train.count() == manifest["counts"]["splits"]["train"] and back.train.where("event_id is null").count() == 0
    with pytest.raises(FileExistsError):
        artifacts.write_dataset(done.splits, done.events, done.mapping, path, ["event_id"])
    assert artifacts.patch_record(spark, f"{path}/manifest", k=5)["k"] == 5 and artifacts.read_record(spark, f"{path}/manifest")["k"] == 5
    assert artifacts.reusable(spark, f"{path}/manifest", {"k": 5}) and not artifacts.reusable(spark, f"{path}/nothing", {})
    with pytest.raises(artifacts.StaleResult):
        artifacts.reusable(spark, f"{path}/manifest", {"k": 6})
    assert artifacts.resumable_run({"seed": 1}, {"seed": 1}) and not artifacts.resumable_run({"seed": 1, "test_f1": 0.5}, {"seed": 1})
    made = []
    for _ in range(2):
        artifacts.cached_table(spark, path, "key", lambda: made.append(1) or spark.range(3)).count()
    assert made == [1]


def test_stream_equals_batch(spark, tmp_path):
    schema = "source bigint, target bigint, ts bigint, sign int"
    for k, part in enumerate(([(1, 2, 10, 1), (2, 3, 5, -1)], [(2, 1, 20, -1)], [(1, 2, 15, 1), (3, 2, 4, 1)])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    start_memory(streaming_latest(stream, ["ts"], "sign"), "latest_pairs").awaitTermination()
    assert {tuple(r) for r in spark.table("latest_pairs").collect()} == {(1, 2, -1), (2, 3, -1)}


# ---------------------------------------------------------------------------------- synthetic graphs
def test_panels_keep_their_counts_and_nest(spark):
    nodes = synthetic.balanced_communities(spark, 60, 3)
    pools = synthetic.pair_pools(nodes)
    low, high = (synthetic.exact_layer(pools, n, 0.7, 1).select("source", "target") for n in (100, 200))
    assert low.join(high, ["source", "target"], "left_anti").count() == 0 and high.count() == 200
    panel = synthetic.structural_panel(spark, 60, 3, 300, 60, [0.5, 0.9], [0.6, 1.0])
    synthetic.check_panel(panel, 60)
    assert {r["n"] for r in panel.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()} == {360}
    p_in = synthetic.within_probability(60, 3, 300.0, 0.05)
    assert p_in * 3 * 190 + 0.05 * 1200 == pytest.approx(300)
    q_in, q_out = synthetic.negative_probabilities(570, 1200, 60, 0.8)
    assert q_in * 570 == pytest.approx(12) and q_out * 1200 == pytest.approx(48)
    with pytest.raises(ValueError):
        synthetic.check_panel(panel, 61)


def test_opinions(spark):
    nodes = synthetic.balanced_communities(spark, 200, 4)
    for kind in ("uniform", "power_law", "aligned", "reflected_normal"):
        low, high = synthetic.opinions(nodes, kind, 3).agg(F.min("opinion"), F.max("opinion")).first()
        assert -1 <= low < 0 < high <= 1
    aligned = synthetic.opinions(nodes, "aligned", 3)
    mixed = synthetic.permuted_opinions(aligned, 1)
    assert sorted(r["opinion"] for r in aligned.collect()) == sorted(r["opinion"] for r in mixed.collect()) and mixed.count() == 200


def test_resolved_paths():
    have = {"/new/data/x/1.parquet"}
    assert synthetic.resolve_path("/old/data/x/1.parquet", "/new/data", have.__contains__) == "/new/data/x/1.parquet"
    with pytest.raises(FileNotFoundError):
        synthetic.resolve_path("/old/y", "/new/data", have.__contains__)


def test_quick_pipeline(spark):
    r = random.Random(8)
    rows = []
    for i in range(900):
        a, b = r.randint(0, 39), r.randint(0, 39)
        rows.append((i, str(a), str(b), (1.0 if a // 20 == b // 20 else -1.0) * r.choice([1, 2]), i))
    raw = spark.createDataFrame(rows, "line_no bigint, source string, target string, weight double, timestamp bigint")
    out = pipeline.quick(raw, True, k=3, config=EncoderConfig(8, 8, 2, 0.02, 30))
    assert out["num_nodes"] == 40 and out["added"] > 0 and 0 <= out["macro_f1_before"] <= 1 and out["score_after"] > 0


def test_catalogue_is_consistent(spark):
    queries, sql = catalogue.queries(), catalogue.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 90 and all(isinstance(s, str) for s in sql.values())
    first = catalogue.FLAGSHIP(spark, "/root/testdata/sf0.001")
    assert first.count() > 0


def test_commands_run_one_after_another(spark, tmp_path, monkeypatch):
    from signetry.__main__ import main

    r = random.Random(3)
    lines = []
    for i in range(900):
        a, b = r.randint(0, 39), r.randint(0, 39)
        lines.append(f"{a},{b},{(1 if a // 20 == b // 20 else -1) * r.choice([1, 2])},{i}")
    (tmp_path / "raw.csv").write_text("\n".join(lines))
    root = f"file://{tmp_path}"
    data, edges = f"{root}/set", f"{root}/set/train_snapshot_undirected"
    main(["preprocess", "ra", f"{root}/raw.csv", data])
    main(["communities", data, "--minimum-size", "2", "--seeds", "2"])
    assert artifacts.read_record(spark, f"{data}/manifest")["communities"]["selected_k"] >= 1
    main(["train", edges, f"{root}/state", "--dimension", "6", "--epochs", "10"])
    main(["measure", edges, f"{root}/state", "--k", "2", "--output", f"{root}/measure"])
    assert artifacts.read_record(spark, f"{root}/measure")["polarization"] > 0
    main(["communities", data, "--minimum-size", "2", "--seeds", "2"])  # as it is
    with pytest.raises(artifacts.StaleResult):
        main(["communities", data, "--minimum-size", "3", "--seeds", "2"])
    assert spark.read.csv(f"{data}/communities_seed_1", header=True).count() > 0
    main(["evaluate", data, f"{root}/state", "--measurement", f"{root}/measure"])
    with pytest.raises(artifacts.StaleResult):
        main(["evaluate", data, f"{root}/state", "--measurement", f"{root}/measure", "--eta", "0.2"])
    tune = ["tune", data, f"{root}/tuned", "--seeds", "1", "--dimensions", "4", "6", "--learning-rates", "0.01", "--epoch-choices", "5", "--cache", f"{root}/features"]
    main(tune)
    with monkeypatch.context() as m:
        m.setattr(pipeline, "train_state", lambda *a: 1 / 0)
        main([*tune, "--prune"])
    assert spark.read.parquet(f"{root}/tuned/selected_runs").count() == 1
    main(["prepare", f"{root}/state", f"{root}/prepared", "--k", "3", "--minimum-size", "2"])
    main(["sample-candidates", f"{root}/prepared", edges, f"{root}/pool", "--cap", "40"])
    main(["select", edges, f"{root}/state", f"{root}/pool", f"{root}/selection", "--k", "2", "--rate", "0.02"])
    main(["materialize", data, f"{root}/selection", f"{root}/augmented", "--rate", "0.02", "--directed"])
    base = spark.read.parquet(edges).count()
    assert spark.read.parquet(f"{root}/augmented/augmented_undirected").count() > base
    main(["random", edges, f"{root}/random", "--rate", "0.02"])
    main(["evaluate", data, f"{root}/state"])
    assert spark.read.parquet(f"{root}/random").count() > base
