"""Leave-one-out, the one-class classifier and the local outlier factor against plain definitions."""

import random

import numpy as np
import pytest

from termforge.operators import models, stats

SCHEMA = "outer_fold int, inner_fold int, doc_id long, role string, label int, features array<double>"


def rows(n, d=6, seed=0):
    rng = np.random.default_rng(seed)
    x = (rng.random((n, d)) < 0.4).astype(float)
    y = (x @ rng.normal(size=d) + 0.7 * rng.normal(size=n) > 0).astype(int)
    return x, y


@pytest.mark.parametrize(("kernel", "c", "gamma"), [("linear", 1.0, 1.0), ("rbf", 10.0, 0.3)])
def test_leave_one_out_equals_plain_fits(spark, kernel, c, gamma):
    x, y = rows(40)
    frame = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(40)], "doc_id long, label int, features array<double>")
    got = {r.doc_id: r for r in models.leave_one_out(frame, kernel, c, gamma).collect()}
    assert sorted(got) == list(range(40))
    for i in range(40):
        keep = np.arange(40) != i
        duals, bias, _ = models.svc_fit(models.kernel_matrix(x[keep], x[keep], kernel, gamma), y[keep], c, 1e-10)
        want = float((models.kernel_matrix(x[i : i + 1], x[keep], kernel, gamma) @ duals)[0] + bias)
        assert got[i].decision == pytest.approx(want, abs=1e-5) and got[i].label == y[i] and got[i].status == "ok"
        assert got[i].predicted == int(got[i].decision > 0)


def test_leave_one_out_of_few_rows(spark):
    schema = "doc_id long, label int, features array<double>"
    lone = [(1, 1, [1.0]), (2, 0, [0.0]), (3, 0, [0.5])]
    got = {r.doc_id: r.status for r in models.leave_one_out(spark.createDataFrame(lone, schema), "linear", 1.0).collect()}
    assert got == {1: "one_class", 2: "ok", 3: "ok"}
    assert models.leave_one_out(spark.createDataFrame([], schema), "linear", 1.0).count() == 0
    with pytest.raises(ValueError, match="at most 2"):
        models.leave_one_out(spark.createDataFrame(lone, schema), "linear", 1.0, most_rows=2)


@pytest.mark.parametrize("nu", [0.05, 0.3, 0.5, 0.9])
@pytest.mark.parametrize("kernel", ["rbf", "linear"])
def test_one_class_is_optimal(nu, kernel):
    x = np.random.default_rng(3).normal(size=(80, 4)) + 1
    k = models.kernel_matrix(x, x, kernel, 0.2)
    a, offset, good = models.one_class_fit(k, nu)
    decision = k @ a - offset
    assert good and a.sum() == pytest.approx(nu * 80) and a.min() >= 0 and a.max() <= 1
    assert (decision[a < 1e-9] >= -1e-6).all() and (decision[a > 1 - 1e-9] <= 1e-6).all()
    assert np.abs(decision[(a > 1e-9) & (a < 1 - 1e-9)]).max(initial=0) < 1e-6
    assert (decision < -1e-6).sum() <= nu * 80 + 1e-9 and (a > 1e-9).sum() >= nu * 80 - 1e-9


def test_one_class_of_contexts(spark):
    x, y = rows(60, seed=4)
    frame = spark.createDataFrame([(o, -1, i, "test" if i % 3 == o else "train", int(y[i]), x[i].tolist()) for o in (0, 1) for i in range(60)], SCHEMA)
    got = models.one_class(frame, "rbf", [0.2, 0.5]).collect()
    for o in (0, 1):
        own = [i for i in range(60) if i % 3 != o and y[i] == 1]
        for nu in (0.2, 0.5):
            mine = [r for r in got if (r.outer_fold, r.nu) == (o, nu)]
            assert sorted(r.doc_id for r in mine) == sorted(own + [i for i in range(60) if i % 3 == o])
            assert sum(r.role == "train" and r.predicted == 0 for r in mine) <= nu * len(own)
    none = [(0, -1, i, "train" if i else "test", 0, [1.0]) for i in range(4)]
    assert models.one_class(spark.createDataFrame(none, SCHEMA), "rbf", [0.2]).count() == 0


def test_local_outlier_factor(spark):
    rng = random.Random(5)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(80)] + [(100, [9.0, 9.0, 9.0])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    e = {i: np.array(v, np.float32).astype(float) for i, v in vectors}
    near = {i: sorted((round(float(np.sqrt(((e[i] - e[j]) ** 2).sum())), 6), j) for j in e if j != i)[:5] for i in e}
    dense = {i: 1 / (np.mean([max(d, near[j][-1][0]) for d, j in near[i]]) + 1e-10) for i in e}
    got = {r.vec_id: r for r in stats.local_outlier_factor(frame, "vec_id % 20 = 0", 5).collect()}
    assert sorted(got) == [0, 20, 40, 60, 100]
    for i, r in got.items():
        assert r.density == pytest.approx(dense[i], abs=2e-6) and r.factor == pytest.approx(np.mean([dense[j] for _, j in near[i]]) / dense[i], abs=2e-6)
    assert got[100].factor > 3 > got[0].factor


def test_neighbours_in_blocks(spark):
    rng = random.Random(6)
    frame = spark.createDataFrame([(i, [rng.random(), rng.random()]) for i in range(90)], "vec_id long, embedding array<float>")
    whole, parts = (sorted(map(tuple, stats.nearest(frame, "vec_id % 2 = 0", 3, 0.1, block).collect())) for block in (4096, 10))
    assert whole == parts and len(whole) == 45 * 3
