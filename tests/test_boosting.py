"""The histogram booster against a plain one, split by split, and its gate, grids and odd tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from termforge.operators import boosting as B
from termforge.operators import models

SCHEMA = "outer_fold int, inner_fold int, doc_id long, role string, label int, features array<double>"


def table(seed=0, n=60, k=4, contexts=((0, -1), (1, -1)), noise=1.0):
    rng = random.Random(seed)
    rows = []
    for o, i in contexts:
        for d in range(n):
            x = [float(rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(k - 1)] + [round(rng.random(), 3)]
            y = int(x[0] + x[1] * x[2] + noise * rng.random() > 1.5)
            rows.append((o, i, d, "test" if d % 5 == o else "train", y, x))
    return rows


def plain(x, y, w, series, trees, reg=0.0):
    """A booster over all cuts of all values, in numpy: (trees as {node: (feature, cut value, gain)}, scores)."""
    score, out = np.zeros(len(y)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = np.round((p - y) * w * B.UNIT), np.round(p * (1 - p) * w * B.UNIT)

        def best(rows, g=g, h=h):
            found = None
            gt, ht = g[rows].sum() / B.UNIT, h[rows].sum() / B.UNIT
            for j in range(x.shape[1]):
                for v in sorted(set(x[rows, j]))[1:]:
                    left = rows[x[rows, j] < v]
                    gl, hl = g[left].sum() / B.UNIT, h[left].sum() / B.UNIT
                    gr, hr = gt - gl, ht - hl
                    if hl < series.min_child_weight or hr < series.min_child_weight:
                        continue
                    gain = round(gl * gl / (hl + reg) + gr * gr / (hr + reg) - gt * gt / (ht + reg), 9)
                    if gain > 0 and (found is None or gain > found[0]):
                        found = (gain, j, v)
            return found

        held, split = {1: np.arange(len(y))}, {}
        cuts = {1: best(held[1])}
        while True:
            deepest = 60 if series.max_depth < 0 else series.max_depth
            open_ = [n for n, c in cuts.items() if c and n not in split and n.bit_length() <= deepest]
            if not open_ or series.grow == "leaf" and len(split) == series.num_leaves - 1:
                break
            n = min(open_, key=lambda n: (-cuts[n][0], n))
            split[n] = cuts[n]
            rows, (_, j, v) = held.pop(n), cuts[n]
            for child, own in ((2 * n, rows[x[rows, j] < v]), (2 * n + 1, rows[x[rows, j] >= v])):
                held[child], cuts[child] = own, best(own)
        for rows in held.values():
            score[rows] -= series.learning_rate * g[rows].sum() / (h[rows].sum() + reg * B.UNIT)
        out.append(split)
    return out, score


def weights(y, grow):
    k1, k0 = (y == 1).sum(), (y == 0).sum()
    return np.where(y == 1, len(y) / (2 * k1), len(y) / (2 * k0)) if grow == "leaf" else np.where(y == 1, k0 / k1, 1.0)


@pytest.mark.parametrize("series", [B.Series("depth", 3, 31, 0.3, 0.0), B.Series("depth", 2, 31, 0.5, 3.0), B.Series("leaf", -1, 5, 0.3, 0.0), B.Series("leaf", 2, 7, 0.1, 0.0)], ids=str)
def test_splits_equal_a_plain_booster(spark, series, monkeypatch):
    monkeypatch.setattr(B, "REFRESH", 2)  # the state is written and read back on the way
    rows = table()
    found, _ = B.fit(spark.createDataFrame(rows, SCHEMA), [series], 3)
    assert sorted(found) == [(0, -1, 0), (1, -1, 0)]
    for (o, i, _), trees in found.items():
        own = [r for r in rows if r[0] == o and r[3] == "train"]
        x, y = np.array([r[5] for r in own]), np.array([r[4] for r in own])
        want, _ = plain(x, y, weights(y, series.grow), series, 3)
        for (tree, split), w in zip(trees, want, strict=True):
            cuts = {n: (tree.nodes[n].feature, sorted(set(x[:, tree.nodes[n].feature]))[tree.nodes[n].cut]) for n in split}
            assert cuts == {n: (j, v) for n, (_, j, v) in w.items()}
            assert all(tree.nodes[n].gain == pytest.approx(w[n][0], abs=1e-6) for n in split)


def test_decisions_gate_and_shared_trees(spark):
    rows = table(seed=3, contexts=((0, -1), (0, 0)))
    frame = spark.createDataFrame(rows, SCHEMA)
    grid = B.grid(spark, {"n_estimators": [2, 4], "max_depth": [3], "learning_rate": [0.5], "min_child_weight": [0, 2]}, "depth")
    got = B.evaluate(frame, grid, 0.5).collect()
    statuses = set()
    for g in grid.collect():
        series = B.Series("depth", 3, 31, 0.5, g["min_child_weight"])
        for o, i in ((0, -1), (0, 0)):
            train, test = ([r for r in rows if (r[0], r[1], r[3]) == (o, i, role)] for role in ("train", "test"))
            x, y = np.array([r[5] for r in train]), np.array([r[4] for r in train])
            _, score = plain(x, y, weights(y, "depth"), series, g["n_estimators"])
            own = [r for r in got if (r["outer_fold"], r["inner_fold"], r["candidate_index"]) == (o, i, g["candidate_index"])]
            assert sorted(r["doc_id"] for r in own) == [r[2] for r in test]
            status = "ok" if (np.where(y == 1, 1, -1) * score >= 0.5).all() else "invalid_margin"
            assert {r["status"] for r in own} == {status} and all(r["predicted"] == (r["decision"] > 0) and r["param_label"] == g["param_label"] for r in own)
            statuses.add(status)
            same = {tuple(v): s for v, s in zip(x.tolist(), score)}
            for r in test:
                if tuple(r[5]) in same:
                    assert next(z["decision"] for z in own if z["doc_id"] == r[2]) == pytest.approx(same[tuple(r[5])], abs=1e-6)
    assert statuses == {"ok", "invalid_margin"}


def test_records_and_statuses_of_a_grid(spark):
    frame = spark.createDataFrame(table(seed=3, contexts=((0, -1), (0, 0), (1, -1), (1, 0)), noise=0.0), SCHEMA)
    grid = B.grid(spark, {"n_estimators": [1, 3], "max_depth": [6], "learning_rate": [0.5], "min_child_weight": [0]}, "depth")
    records, statuses = models.candidate_records(frame, grid, 1.1, run=B.evaluate)
    assert {r["candidate_index"]: r["status"] for r in statuses.collect()} == {0: "dropped", 1: "valid"}
    assert [(r["outer_fold"], r["candidate_index"]) for r in records.orderBy("outer_fold").collect()] == [(0, 1), (1, 1)]


def test_quantile_bins_hold_no_value_back(spark):
    """More values than bins: as many cut points at most, rows spread evenly, a value of a third of the rows in one bin."""
    rows = [(0, -1, d, "train", d % 2, [float(d if d >= 100 else 0)]) for d in range(300)]
    (got,) = B.cut_points(spark.createDataFrame(rows, SCHEMA), 16).collect()
    edges = got["edges"][0]
    assert edges == sorted(edges) and 10 <= len(edges) < 16 and all(100 <= e <= 299 for e in edges)
    sizes = np.diff([0, *[100 + int(e) - 100 for e in edges], 300])
    assert max(sizes[1:]) <= 20
    assert B.cut_points(spark.createDataFrame(rows, SCHEMA), 255).collect()[0]["edges"][0] == [float(v) for v in range(100, 300)]


def test_one_class_empty_and_constant_tables(spark):
    grid = B.grid(spark, {"n_estimators": [2], "max_depth": [2], "learning_rate": [0.5]}, "depth")
    one = [(0, -1, d, "test" if d > 7 else "train", 1, [float(d)]) for d in range(10)]
    flat = [(1, -1, d, "test" if d > 7 else "train", d % 2, [5.0]) for d in range(10)]
    got = B.evaluate(spark.createDataFrame(one + flat, SCHEMA), grid, None).collect()
    assert {(r["outer_fold"], r["status"], r["decision"]) for r in got} == {(0, "one_class", 0.0), (1, "ok", 0.0)} and len(got) == 4
    assert B.evaluate(spark.createDataFrame([], SCHEMA), grid, None).count() == 0
    assert B.evaluate(spark.createDataFrame(one, SCHEMA), grid.limit(0), None).count() == 0


def test_grids_are_whole(spark):
    assert B.grid(spark, B.LEAF_GRID, "leaf").count() == 1764 and B.grid(spark, B.DEPTH_GRID, "depth").count() == 1512
    assert math.prod(map(len, B.LEAF_GRID.values())) == 1764
    assert B.grid(spark, {"n_estimators": [5], "num_leaves": [7], "max_depth": [-1], "learning_rate": [0.05]}, "leaf").select(F.first("param_label")).first()[0] == "n_estimators=5, num_leaves=7, max_depth=-1, learning_rate=0.05"
