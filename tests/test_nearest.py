"""Nearest rows by matrix products against every distance as Spark's own expression."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from termforge.operators import stats


def want(vectors, k):
    square = F.aggregate(F.zip_with("e", "embedding", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda a, b: a + b)
    q = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("e"))
    rows = vectors.crossJoin(q).filter("vec_id <> qid").select("qid", F.round(F.sqrt(square), 6).alias("dist"), "vec_id").collect()
    by = {}
    for r in rows:
        by.setdefault(r.qid, []).append((r.dist, r.vec_id))
    return {i: sorted(v)[:k] for i, v in by.items()}


@pytest.mark.parametrize("shift", [0.0, 100.0])
def test_nearest_equals_all_distances(spark, monkeypatch, shift):
    """Copies, near ties below the sixth decimal, and vectors far from the origin, where single precision says little."""
    monkeypatch.setattr(stats, "TILE", 64)
    rng = np.random.default_rng(2)
    e = rng.normal(size=(700, 12)) + shift
    e[100:160] = e[40]
    e[200:240] = e[60] + 1e-7 * rng.normal(size=(40, 12))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(e)], "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in stats.nearest(frame, "vec_id % 20 = 0", 5, 0.1, 16).collect():
        got.setdefault(r.qid, []).append((r.dist, r.vec_id))
    assert {i: sorted(v) for i, v in got.items()} == want(frame, 5)
    assert "MapInPandas" in stats.nearest(frame, "vec_id % 20 = 0", 5, 0.1)._jdf.queryExecution().toString()


def test_nearest_of_few_and_odd_rows(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 4.0])], schema)
    assert [(r.qid, r.vec_id, r.dist) for r in stats.nearest(few, "vec_id = 0", 5, 0.1).collect()] == [(0, 1, 5.0)]
    assert stats.nearest(few, "vec_id = 7", 5, 0.1).count() == 0
    odd = spark.createDataFrame([(0, [0.0]), (1, [2.0]), (2, [float("nan")])], schema)
    assert [(r.vec_id, r.dist) for r in stats.nearest(odd, "vec_id = 0", 1, 0.1).collect()] == [(1, 2.0)]
