"""python -m signetry COMMAND ...: the commands of the pipeline over Parquet tables and raw logs."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pipeline
from .operators import communities, interventions, learning, polarization
from .operators.encoders import ENCODERS, EncoderConfig
from .operators.events import fingerprint
from .session import stored
from .sources import artifacts
from .sources.readers import DATASETS, Splits, read_state, resolve_dataset


def _edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("source", "target", F.col("sign").cast("int").alias("sign"))


def _dense(edges: DataFrame) -> int:
    return edges.agg(F.max(F.greatest("source", "target"))).first()[0] + 1


def preprocess(spark, a) -> None:
    for name in resolve_dataset(a.dataset):
        print(pipeline.build_dataset(spark, name, a.raw, f"{a.output}/{name}" if a.dataset == "all" else a.output, a.seed, a.overwrite, a.sha256))


def communities_(spark, a) -> None:
    """Communities of every seed and their number; what was made of the same graph and settings is left as it is."""
    edges = stored(_edges(spark, f"{a.data}/train_snapshot_undirected"))
    wanted = {"minimum_size": a.minimum_size, "seeds": a.seeds, "graph_fingerprint": fingerprint(edges).first()["fingerprint"]}
    if not a.overwrite and artifacts.reusable(spark, f"{a.data}/communities_record", wanted):
        print(artifacts.read_record(spark, f"{a.data}/communities_record"))
        return
    row = communities.estimate_k(edges, a.minimum_size, list(range(a.seeds))).first()
    runs = stored(communities.louvain_runs(edges, list(range(a.seeds))))
    for seed in range(a.seeds):
        own = runs.where(F.col("seed") == seed).select("node_id", "community")
        artifacts.write_communities(communities.packed_communities(own), f"{a.data}/communities_seed_{seed}", True)
    artifacts.write_record(spark, wanted | {"selected_k": row["selected_k"]}, f"{a.data}/communities_record")
    print(artifacts.patch_record(spark, f"{a.data}/manifest", communities={"selected_k": row["selected_k"], "minimum_size": a.minimum_size, "k_source": "computed"}))


def train(spark, a) -> None:
    edges = _edges(spark, a.edges)
    config = EncoderConfig(a.dimension, a.dimension, a.layers, a.learning_rate, a.epochs)
    artifacts.write_state(pipeline.train_state(edges, _dense(edges), a.model, config, a.seed, a.cache), a.output, a.overwrite)


def tune(spark, a) -> None:
    """Every configuration with every seed; runs whose record matches and never saw the test split are taken again."""
    data = Splits.load(spark, a.data, read_test=False)
    train_, val = (stored(p.select("source", "target", "sign")) for p in (data.train, data.val))
    mark = fingerprint(train_).first()["fingerprint"]
    rows = []
    choices = {"dimension": a.dimensions or [a.dimension], "layers": a.layer_choices or [a.layers], "learning_rate": a.learning_rates, "epochs": a.epoch_choices}
    for r in learning.grid(spark, **choices).collect():
        own = {k: r[k] for k in choices}
        for seed in range(a.seeds):
            place = "/".join([f"{a.output}/runs/{a.model}", *(f"{k}_{learning.run_token(v)}" for k, v in own.items()), f"seed_{seed}"])
            wanted = own | {"seed": seed, "model": a.model, "graph_fingerprint": mark}
            record = artifacts.read_record(spark, f"{place}/record") if artifacts.path_exists(spark, f"{place}/record") else None
            if not artifacts.resumable_run(record, wanted):
                config = EncoderConfig(own["dimension"], own["dimension"], own["layers"], own["learning_rate"], own["epochs"])
                state = stored(pipeline.train_state(train_, data.num_nodes, a.model, config, seed, a.cache))
                record = wanted | {"validation_macro_f1": pipeline.evaluate(train_, val, val, state).first()["macro_f1"]}
                artifacts.write_state(state, f"{place}/state", True)
                artifacts.write_record(spark, record, f"{place}/record")
            rows.append((seed, own["dimension"], own["layers"], own["learning_rate"], own["epochs"], record["validation_macro_f1"], place))
    runs = spark.createDataFrame(rows, "seed int, dimension bigint, layers bigint, learning_rate double, epochs bigint, validation_macro_f1 double, run_dir string")
    by = list(choices)
    selected = stored(learning.runs_of(runs, learning.select_configuration(runs, by), by))
    artifacts.write_table(runs, f"{a.output}/validation_candidates", True)
    artifacts.write_table(selected, f"{a.output}/selected_runs", True)
    if a.prune:
        print(artifacts.prune_runs(runs, selected))


def evaluate(spark, a) -> None:
    """Test metrics; with a measurement given, only if it was made of this graph and state."""
    state = read_state(spark, a.state)
    if a.measurement:
        graph = fingerprint(_edges(spark, f"{a.data}/train_snapshot_undirected")).first()["fingerprint"]
        artifacts.check_measurement(artifacts.read_record(spark, a.measurement), graph, artifacts.state_fingerprint(state), a.eta, a.alpha)
    data = Splits.load(spark, a.data)
    parts = [p.select("source", "target", "sign") for p in (data.train, data.val, data.test)]
    pipeline.evaluate(*parts, state, a.labels, a.seed).show(truncate=False)


def measure(spark, a) -> None:
    edges, state = _edges(spark, a.edges), read_state(spark, a.state)
    out = stored(polarization.measure(edges, state, a.k, a.eta, a.alpha))
    out.show(truncate=False)
    if a.output:
        marks = {"graph_fingerprint": fingerprint(edges).first()["fingerprint"], "state_fingerprint": artifacts.state_fingerprint(state), "schema_version": artifacts.VERSION}
        artifacts.write_record(spark, out.first().asDict() | marks, a.output)


def sensitivity(spark, a) -> None:
    polarization.sensitivity(_edges(spark, a.edges), read_state(spark, a.state), a.k, a.eta, a.alpha).show(truncate=False)


def prepare(spark, a) -> None:
    partition, gray = pipeline.gray_zones(read_state(spark, a.state), a.k, a.minimum_size)
    artifacts.write_table(partition, f"{a.output}/kmeans_nodes", a.overwrite)
    artifacts.write_table(gray, f"{a.output}/gray_rankings", a.overwrite)


def sample_candidates(spark, a) -> None:
    partition, gray = spark.read.parquet(f"{a.preparation}/kmeans_nodes"), spark.read.parquet(f"{a.preparation}/gray_rankings")
    artifacts.write_table(interventions.candidate_pool(gray, partition, _edges(spark, a.edges), a.cap, a.seed), a.output, a.overwrite)


def select(spark, a) -> None:
    edges, state = _edges(spark, a.edges), read_state(spark, a.state)
    coordinates, _ = polarization.opinion_coordinates(state, a.k)
    pool, n = spark.read.parquet(a.candidates), state.count()
    budget = interventions.budget_plan(edges.count(), [a.rate])["budgets"][0]
    if a.batch:
        chosen = interventions.batched_greedy(edges, coordinates, pool, budget, a.batch, n, a.equal, a.eta, a.alpha)
    else:
        chosen = interventions.greedy_order(edges, coordinates, pool, budget, n, a.eta, a.alpha)
    chosen = stored(chosen)
    artifacts.write_table(chosen, f"{a.output}/selected_edges", a.overwrite)
    plan = interventions.budget_plan(edges.count(), [a.rate])["checkpoints"]
    artifacts.write_table(interventions.prefix_energies(edges, coordinates, chosen, sorted(set(plan)), n, a.eta, a.alpha), f"{a.output}/budget_curve", a.overwrite)


def materialize(spark, a) -> None:
    chosen = spark.read.parquet(f"{a.selection}/selected_edges")
    base = spark.read.parquet(f"{a.data}/train_snapshot_undirected")
    budget = interventions.budget_plan(base.count(), [a.rate])["budgets"][0]
    additions = interventions.sampled_batch(chosen, budget).select("source", "target")
    interventions.augment(base, additions)
    artifacts.write_augmented(additions, spark.read.parquet(f"{a.data}/train_snapshot_directed"), base, a.output, a.directed, a.overwrite)


def random_(spark, a) -> None:
    edges = _edges(spark, a.edges).withColumn("weight", F.col("sign").cast("double"))
    budget = interventions.budget_plan(edges.count(), [a.rate])["budgets"][0]
    artifacts.write_table(interventions.random_baseline(edges, _dense(edges), budget, a.seed), a.output, a.overwrite)


def graph_wide(spark, a) -> None:
    edges, state = _edges(spark, a.edges), read_state(spark, a.state)
    coordinates, _ = polarization.opinion_coordinates(state, a.k)
    plan = interventions.budget_plan(edges.count(), [a.rate])
    artifacts.write_table(interventions.global_baseline(edges, coordinates, state.count(), plan["candidate_cap"], plan["budgets"][0], a.seed), a.output, a.overwrite)


COMMANDS = {
    "preprocess": (preprocess, "dataset raw output"), "communities": (communities_, "data"), "train": (train, "edges output"), "tune": (tune, "data output"), "evaluate": (evaluate, "data state"), "measure": (measure, "edges state"), "sensitivity": (sensitivity, "edges state"),
    "prepare": (prepare, "state output"), "sample-candidates": (sample_candidates, "preparation edges output"), "select": (select, "edges state candidates output"), "materialize": (materialize, "data selection output"), "random": (random_, "edges output"), "graph-wide": (graph_wide, "edges state output"),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="signetry", description=f"Known data sets: {', '.join(DATASETS)}")
    commands = out.add_subparsers(dest="command", required=True)
    for name, (_, places) in COMMANDS.items():
        p = commands.add_parser(name)
        for place in places.split():
            p.add_argument(place)
        if "output" not in places:
            p.add_argument("--output")
        for option, default in (("seed", 0), ("seeds", 10), ("k", 8), ("minimum-size", 30), ("cap", 1000), ("labels", 2), ("dimension", 64), ("layers", 2), ("epochs", 100), ("batch", 0)):
            p.add_argument(f"--{option}", type=int, default=default)
        for option, default in (("eta", 0.1), ("alpha", 0.05), ("rate", 0.05), ("learning-rate", 0.01)):
            p.add_argument(f"--{option}", type=float, default=default)
        p.add_argument("--model", choices=sorted(ENCODERS), default="undirected")
        for option in ("sha256", "cache", "measurement"):
            p.add_argument(f"--{option}")
        for option in ("dimensions", "layer-choices"):
            p.add_argument(f"--{option}", type=int, nargs="+")
        p.add_argument("--learning-rates", type=float, nargs="+", default=[0.01, 0.001, 0.0001])
        p.add_argument("--epoch-choices", type=int, nargs="+", default=[50, 100, 200])
        for flag in ("overwrite", "directed", "equal", "prune"):
            p.add_argument(f"--{flag}", action="store_true")
    return out


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("signetry").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    COMMANDS[args.command][0](spark, args)


if __name__ == "__main__":
    main()
