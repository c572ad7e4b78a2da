"""Principal components of sparse matrices against a dense decomposition."""

import numpy as np
import pytest

from termforge.operators import components


def matrix(n=200, d=60, seed=1):
    rng = np.random.default_rng(seed)
    parts = rng.normal(size=(n, 4)) @ (np.array([9, 6, 4, 2.5])[:, None] * rng.normal(size=(4, d)))
    x = np.maximum(parts + 0.3 * rng.normal(size=(n, d)), 0)
    x[rng.random((n, d)) < 0.6] = 0
    x[7] = 0  # a document without postings
    return x


def frames(spark, x):
    posted = [(i, f"t{j:03d}", float(x[i, j])) for i in range(len(x)) for j in range(x.shape[1]) if x[i, j]]
    return spark.createDataFrame(posted, "doc_id long, term string, value double").repartition(3), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(len(x))], "doc_id long, label int")


def test_equals_a_dense_decomposition(spark):
    x = matrix()
    scores, loadings, shares = components.principal(*frames(spark, x), 3)
    centred = x - x.mean(0)
    u, s, v = np.linalg.svd(centred, full_matrices=False)
    assert shares == pytest.approx((s**2 / (s**2).sum())[:3].tolist(), abs=1e-9)
    got = {r.term: r.loading for r in loadings.collect()}
    mine = np.array([got[f"t{j:03d}"] for j in range(x.shape[1])])
    want = v[:3].T * np.sign(v[:3].T[np.abs(v[:3].T).argmax(0), range(3)])
    assert np.abs(mine - want).max() < 1e-6
    rows = {r.doc_id: r.s for r in scores.collect()}
    assert sorted(rows) == list(range(200)) and np.abs(np.array([rows[i] for i in range(200)]) - centred @ want).max() < 1e-4


def test_report_reads_the_axes(spark):
    x = matrix()
    posted, docs = frames(spark, x)
    scores, loadings, shares = components.principal(posted, docs, 2)
    got = components.report(scores, loadings, shares, docs).orderBy("component").collect()
    own = {r.doc_id: r.s for r in scores.collect()}
    labels = np.array([int(i % 3 == 0) for i in range(200)])
    for j, r in enumerate(got):
        v = np.array([own[i][j] for i in range(200)])
        assert r.label_correlation == pytest.approx(np.corrcoef(v, labels)[0, 1], abs=1e-8)
        assert r.label1_mean == pytest.approx(v[labels == 1].mean(), abs=1e-8) and r.cumulative == pytest.approx(sum(shares[: j + 1]), abs=1e-9)
        by = sorted(((-round(z.loading[j], 9), z.term) for z in loadings.collect()))
        assert [t.split(":")[0] for t in r.top_terms.split(", ")] == [t for _, t in by[:5]]


def test_fewer_columns_than_components_and_empty(spark):
    posted, docs = frames(spark, matrix(12, 3))
    scores, loadings, shares = components.principal(posted, docs, 5)
    assert len(shares) == 3 and sum(shares) == pytest.approx(1.0) and loadings.count() == 3 and scores.count() == 12
    scores, loadings, shares = components.principal(posted.limit(0), docs, 2)
    assert (scores.count(), loadings.count(), shares) == (0, 0, [])
