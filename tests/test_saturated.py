import pytest

from signetry.operators import interventions as iv
from signetry.operators import learning
from signetry.plans import mitigation

EDGES = "source bigint, target bigint, sign int"


@pytest.fixture
def full(spark, monkeypatch):
    """Eighteen nodes without a free pair but (2, 5)."""
    pairs = [(i, j, 1) for i in range(18) for j in range(i + 1, 18) if (i, j) != (2, 5)]
    monkeypatch.setattr(mitigation, "node_count", lambda *a: 18)
    monkeypatch.setattr(mitigation, "vector_graph", lambda *a: spark.createDataFrame(pairs, EDGES))
    return pairs


def test_augment_edges_adds_what_is_free(spark, full):
    assert mitigation.augment_edges(spark, "").count() == len(full) + 1


def test_edge_jaccard_holds_without_enough_free_pairs(spark, full):
    assert mitigation.edge_jaccard(spark, "").first()["jaccard"] == 0.333333


def test_non_edges_gives_all_there_are(spark, full):
    assert [tuple(r) for r in mitigation.non_edges(spark, "").collect()] == [(2, 5, 1)]
    got = iv.non_edges(18, mitigation.vector_graph(), 4, "7", small=5, strict=False)
    assert [tuple(r)[:2] for r in got.collect()] == [(2, 5)]


def test_random_baseline_adds_what_is_free(spark, full):
    assert mitigation.random_baseline(spark, "").count() == len(full) + 1


def test_three_class_examples_with_too_few_free_pairs(spark, full):
    train, none = mitigation.vector_graph(), mitigation.vector_graph().limit(0)
    labels = [r["label"] for r in learning.three_class_examples(train, train, none, none, 18, 3).collect()]
    assert labels.count(2) == 1 and len(labels) == len(full) + 1
