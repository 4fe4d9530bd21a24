import numpy as np

from signetry.operators import interventions


def test_steps_at_once_end_where_sparks_fits_do(spark, monkeypatch):
    from pyspark.ml.clustering import KMeansModel

    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 6)) + 1.5 * rng.standard_normal((7, 6))[rng.integers(0, 7, 600)]
    state = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node_id bigint, state array<double>").repartition(3)
    shown = lambda df: dict(df.select("node_id", "community").collect())
    with monkeypatch.context() as m:
        m.setattr(KMeansModel, "transform", None)  # no fit is gone through
        arrays = shown(interventions.kmeans_communities(state, 7, restarts=4))
    monkeypatch.setattr(interventions, "HELD", 0)
    assert arrays == shown(interventions.kmeans_communities(state, 7, restarts=4)) and len(arrays) == 600


def test_a_run_that_ends_early_keeps_its_cost():
    x = np.array([[0.0], [0.1], [10.0], [10.1], [20.0], [20.1]])
    good, bad = np.array([[0.05], [10.05], [20.05]]), np.array([[0.0], [0.1], [15.0]])
    for starts in ([good, bad], [bad, good]):
        assert interventions._cheapest(x, starts, 5, 1e-8)[0].tolist() == [0, 0, 1, 1, 2, 2]
