import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from signetry.operators import laplacian


def _peak(run):
    tracemalloc.start()
    try:
        out = run()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_edges_and_vectors_reach_the_driver_as_arrays(spark):
    n, m = 50_000, 150_000
    edges = spark.range(m).select((F.col("id") % n).alias("source"), ((F.col("id") * 7 + 1) % n).alias("target"), F.lit(0.5).alias("c"))
    (times, diagonal), held = _peak(lambda: laplacian._held_multiplier(edges, n))
    assert diagonal.sum() == m and np.abs(times(np.ones((n, 1)))).max() < 1e-9
    values = spark.range(m).select(F.col("id").alias("node_id"), F.array(*[F.col("id") + float(i) for i in range(4)]).alias("value"))
    x, drawn = _peak(lambda: laplacian.held_values(values, m))
    assert (x == np.arange(m)[:, None] + np.arange(4)).all()
    assert held < 25 and drawn < 12  # MB; Python rows of the same would be several times as much
