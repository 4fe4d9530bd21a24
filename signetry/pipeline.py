"""The commands of the pipeline as functions over tables, and runs of all of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import sign_of
from .operators import communities, interventions, learning, polarization
from .operators.components import largest_component
from .operators.encoders import ENCODERS, EncoderConfig, spectral_features
from .operators.events import apply_ids, build_events, fingerprint, keep_last, sorted_ids
from .operators.splits import check_splits, split_snapshot
from .session import stored
from .sources.artifacts import cached_table, write_dataset
from .sources.readers import DATASETS, check_checksum, read_raw, resolve_dataset


@dataclass(frozen=True)
class Profile:
    """Budgets and solver settings of small and large graphs."""

    rates: tuple[float, ...] = (0.025, 0.05, 0.075, 0.10)
    rtol: float = 1e-7
    eta: float = 0.1
    alpha: float = 0.05
    minimum_size: int = 30


SMALL = Profile()
LARGE = Profile(rates=(0.025, 0.05), rtol=1e-3, minimum_size=500)


@dataclass
class Prepared:
    splits: DataFrame
    events: DataFrame
    mapping: DataFrame
    num_nodes: int


def preprocess(raw: DataFrame, temporal: bool, seed: int = 0, ratios: tuple[float, float, float] = (0.70, 0.15, 0.15)) -> Prepared:
    """From raw rows to the split largest component: events, keep-last, component, ids, split, checks."""
    events = stored(build_events(raw, temporal))
    graph = keep_last(events, ["event_id"], "sign", "event_id")
    mapping = sorted_ids(largest_component(graph))
    snapshot = stored(apply_ids(graph, mapping))
    kept = apply_ids(events, mapping)
    n = mapping.count()
    splits = stored(split_snapshot(snapshot, seed, ratios))
    check_splits(splits, n)
    return Prepared(splits, kept, mapping.select("node_id", F.col("raw_id").alias("build_node_id")), n)


def build_dataset(spark: SparkSession, name: str, path: str, output: str, seed: int = 0, overwrite: bool = False, sha256: str | None = None) -> dict:
    """A raw file of a known data set preprocessed and written; the manifest is returned. A wrong ``sha256`` is an error."""
    if sha256:
        check_checksum(spark, path, sha256)
    spec = DATASETS[resolve_dataset(name)[0]]
    done = preprocess(read_raw(spark, path, spec["format"]), spec["temporal"], seed)
    return write_dataset(done.splits, done.events, done.mapping, output, ["event_id"], overwrite)


def estimate_k(train: DataFrame, minimum_size: int, seeds: list[int] | None = None) -> int:
    return communities.estimate_k(train, minimum_size, seeds or list(range(10))).first()["selected_k"]


def train_state(train: DataFrame, n: int, encoder: str = "undirected", config: EncoderConfig | None = None, seed: int = 0, cache: str | None = None) -> DataFrame:
    """Node states: spectral features and, on top of them, a trained encoder.

    With a folder as ``cache`` the features of a graph are made once and taken from there by its fingerprint.
    """
    config = config or EncoderConfig()
    width = min(config.input_dimension, n)
    make = lambda: spectral_features(train, n, width)[0]
    features = cached_table(train.sparkSession, cache, f"{fingerprint(train).first()['fingerprint']}_{n}_{width}", make) if cache else make()
    return ENCODERS[encoder]().trained_states(train, features, config, [seed]).select("node_id", "state")


def measure(train: DataFrame, state: DataFrame, k: int, profile: Profile = SMALL) -> DataFrame:
    return polarization.measure(train, state, k, profile.eta, profile.alpha)


def gray_zones(state: DataFrame, k: int, minimum_size: int, labels: DataFrame | None = None, normalize: bool = True) -> tuple[DataFrame, DataFrame]:
    """Communities and gray rankings; ``labels`` (node_id, community) replaces the clustering."""
    partition = stored(labels if labels is not None else interventions.kmeans_communities(state, k))
    coordinates, _ = polarization.opinion_coordinates(state, max(k, 2), normalize)
    return partition, stored(interventions.gray_ranking(coordinates, partition, minimum_size))


def select_edges(train: DataFrame, state: DataFrame, k: int, minimum_size: int, rates: tuple[float, ...], seed: int = 17, labels: DataFrame | None = None, profile: Profile = SMALL) -> tuple[DataFrame, DataFrame]:
    """The greedy order over the candidate pool and the exact energies at its checkpoints."""
    partition, gray = gray_zones(state, k, minimum_size, labels)
    plan = interventions.budget_plan(train.count(), list(rates))
    pool = interventions.candidate_pool(gray, partition, train, plan["candidate_cap"], seed)
    coordinates, _ = polarization.opinion_coordinates(state, k)
    n, budget = state.count(), max(plan["budgets"])
    chosen = stored(interventions.greedy_order(train, coordinates, pool, budget, n, profile.eta, profile.alpha, profile.rtol))
    curve = interventions.prefix_energies(train, coordinates, chosen, plan["checkpoints"], n, profile.eta, profile.alpha)
    return chosen, curve


def evaluate(train: DataFrame, val: DataFrame, test: DataFrame, state: DataFrame, labels: int = 2, seed: int = 0, base_train: DataFrame | None = None) -> DataFrame:
    """One row of test metrics of a probe fitted on the training examples."""
    if labels == 2:
        examples = learning.two_class_examples(train, val, test)
    else:
        examples = learning.three_class_examples(base_train or train, train, val, test, state.count(), seed)
    rows = stored(learning.endpoint_features(examples, state))
    return learning.probe_metrics(rows.where("split = 'train'"), rows.where("split = 'test'"), list(range(labels)))


def panel_measurements(panel: DataFrame, n: int, k: int, seeds: list[int], encoder: str = "undirected", config: EncoderConfig | None = None, done: DataFrame | None = None, profile: Profile = SMALL) -> DataFrame:
    """``level, seed, fingerprint, structural_energy, antagonistic_energy, polarization`` of states trained on each level.

    ``panel`` has ``level, source, target, sign``. Rows of ``done`` whose level, seed and graph fingerprint are the
    same are taken over instead of being trained anew.
    """
    spark = panel.sparkSession
    names = ("level", "seed", "fingerprint", "structural_energy", "antagonistic_energy", "polarization")
    kept = {(r["level"], r["seed"], r["fingerprint"]): r for r in done.collect()} if done is not None else {}  # a row per level and seed
    rows = []
    for level in sorted(r["level"] for r in panel.select("level").distinct().collect()):
        edges = stored(panel.where(F.col("level") == level).select("source", "target", "sign"))
        mark = fingerprint(edges).first()["fingerprint"]
        for seed in seeds:
            if (level, seed, mark) in kept:
                rows.append(tuple(kept[level, seed, mark][c] for c in names))
                continue
            state = stored(train_state(edges, n, encoder, config, seed))
            out = polarization.measure(edges, state, k, profile.eta, profile.alpha).first()
            rows.append((level, seed, mark, out["structural_energy"], out["antagonistic_energy"], out["polarization"]))
    return spark.createDataFrame(rows, "level int, seed int, fingerprint string, structural_energy double, antagonistic_energy double, polarization double")


def quick(raw: DataFrame, temporal: bool, k: int, rate: float = 0.05, minimum_size: int = 2, config: EncoderConfig | None = None) -> dict:
    """One seed of everything: score and test metrics before and after adding edges for one budget."""
    done = preprocess(raw.withColumn("weight", F.col("weight").cast("double")), temporal)
    part = {s: stored(done.splits.where(F.col("split") == s).select("source", "target", "sign")) for s in ("train", "val", "test")}
    state = stored(train_state(part["train"], done.num_nodes, config=config))
    before = measure(part["train"], state, k).first()["polarization"]
    f1_before = evaluate(part["train"], part["val"], part["test"], state).first()["macro_f1"]
    chosen, _ = select_edges(part["train"], state, k, minimum_size, (rate,))
    augmented = stored(interventions.augment(part["train"].withColumn("weight", F.col("sign").cast("double")), chosen.select("source", "target")).select("source", "target", "sign"))
    state_after = stored(train_state(augmented, done.num_nodes, config=config))
    after = measure(augmented, state_after, k).first()["polarization"]
    f1_after = evaluate(augmented, part["val"], part["test"], state_after).first()["macro_f1"]
    return {"num_nodes": done.num_nodes, "added": chosen.count(), "score_before": before, "score_after": after, "macro_f1_before": f1_before, "macro_f1_after": f1_after}


def full(raw: DataFrame, temporal: bool, seeds: list[int], k: int | None = None, profile: Profile = SMALL) -> list[dict]:
    """For every seed: score and metrics of the trained state and the budget curve of the chosen edges."""
    done = preprocess(raw, temporal)
    part = {s: stored(done.splits.where(F.col("split") == s).select("source", "target", "sign")) for s in ("train", "val", "test")}
    k, source = communities.resolved_k(k if k is not None else estimate_k(part["train"], profile.minimum_size), None, 8)
    out = []
    for seed in seeds:
        state = stored(train_state(part["train"], done.num_nodes, seed=seed))
        row = evaluate(part["train"], part["val"], part["test"], state).first().asDict()
        chosen, curve = select_edges(part["train"], state, max(k, 2), profile.minimum_size, profile.rates, profile=profile)
        out.append({"seed": seed, "k": k, "k_source": source, "polarization": measure(part["train"], state, max(k, 1), profile).first()["polarization"], **row, "curve": [r.asDict() for r in curve.collect()], "chosen": chosen.count()})
    return out


__all__ = ["LARGE", "SMALL", "Prepared", "Profile", "build_dataset", "estimate_k", "evaluate", "full", "gray_zones", "measure", "panel_measurements", "preprocess", "quick", "select_edges", "sign_of", "train_state"]
