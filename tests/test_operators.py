"""Hand-computed values for the labelled-corpus operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from termforge.functions import text as T
from termforge.operators import contrast, evaluate, matrix, models, select, splits, stats

CORPUS = "doc_id long, label int, text string"


def values(df, *by):
    return {tuple(r[k] for k in by): r["value"] for r in df.collect()}


def test_normalise(spark):
    row = spark.createDataFrame([("state-of-the-art re-\nentrancy",), ("don't 5% é",)], "t string").select(T.normalize_text(F.col("t")).alias("x"), T.normalize_text(F.col("t"), True, "word").alias("y")).collect()
    assert row[0].x == "state of the art re entrancy"
    assert (row[1].x, row[1].y) == ("dont", "dont 5 percent")
    with pytest.raises(ValueError):
        T.normalize_text(F.lit(""), percent_mode="x")


def test_porter():
    words = {"caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "happy": "happi", "electricity": "electr", "agreed": "agre", "sky": "sky", "adjustable": "adjust", "controlling": "control"}
    assert {w: T.porter(w) for w in words} == words


def test_ngrams_of_short_and_empty(spark):
    rows = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>").select(T.ngrams(F.col("t"), 1, 2).alias("g")).collect()
    assert [r.g for r in rows] == [["a", "b", "c", "a b", "b c"], ["a"], []]


def posting(spark, rows, labels=None):
    data = [(i, (labels or {}).get(i, 1), f"t{j}", int(v)) for i, row in enumerate(rows) for j, v in enumerate(row) if v]
    return spark.createDataFrame(data, "doc_id long, label int, term string, tf long")


def test_log_normalised(spark):
    post = posting(spark, [[0, 1], [1, 4], [2, 0]])
    lens = spark.createDataFrame([(i, 10) for i in range(3)], "doc_id long, len_tokens long")
    got, d = values(matrix.log_normalised(post, lens), "doc_id", "term"), 1 + math.log(10)
    assert got == pytest.approx({(0, "t1"): 1 / d, (1, "t0"): 1 / d, (1, "t1"): (1 + math.log(4)) / d, (2, "t0"): (1 + math.log(2)) / d})


def test_min_max_from_train(spark):
    train, test = matrix.log_numerator(posting(spark, [[0], [1], [4]])), matrix.log_numerator(posting(spark, [[2]]))
    ranges = matrix.column_range(train, spark.createDataFrame([(3,)], "n long"))
    assert values(matrix.min_max(test, ranges), "doc_id")[(0,)] == pytest.approx((1 + math.log(2)) / (1 + math.log(4)))


def test_l2_full_is_not_renormalised(spark):
    full = matrix.l2_rows(matrix.raw(posting(spark, [[3, 4, 12]])))
    assert values(full.filter("term <> 't2'"), "term") == pytest.approx({("t0",): 3 / 13, ("t1",): 4 / 13})


def test_strict_document_frequency(spark):
    rows = [[int(i < 2), int(i < 3), 1] for i in range(100)]
    left = matrix.keep_frequent(posting(spark, rows), spark.createDataFrame([(100,)], "n long"), 0.02, strict=True)
    assert {r.term for r in left.select("term").distinct().collect()} == {"t1", "t2"}


def test_swapped_labels_negate(spark):
    rows, labels = [[1, 2], [0, 3], [4, 0]], {0: 1, 1: 0, 2: 1}
    diff = lambda ls: {r.term: r.difference for r in contrast.difference_table(matrix.raw(posting(spark, rows, ls)), None, "m").collect()}
    assert diff(labels) == {t: -v for t, v in diff({k: 1 - v for k, v in labels.items()}).items()}


def test_vocabulary_is_sorted(spark):
    got = matrix.vocabulary(posting(spark, [[1] * 20])).orderBy("feature_index").collect()
    assert [r.term for r in got] == sorted(r.term for r in got) and [r.feature_index for r in got] == list(range(20))


def test_iqr(spark):
    got = stats.iqr(spark.createDataFrame([("a", float(v)) for v in (1, 2, 2, 3, 100)] + [("a", float("nan"))], "grp string, v double")).first()
    assert (got.q1, got.q3, got.n, got.outliers) == (2.0, 3.0, 5, 1)


def brute_unique(first, second, k):
    """The displacement loop itself: each list proposes in order until it holds k/2 terms; ties go to the second list."""
    lists, half = (first, second), k // 2
    rank = [{t: i for i, t in enumerate(x)} for x in lists]
    held, at = [[], []], [0, 0]
    while any(len(h) < half for h in held):
        side = 0 if len(held[0]) < half else 1
        term = lists[side][at[side]]
        at[side] += 1
        other = 1 - side
        if term in held[other]:
            better = rank[side][term] < rank[other][term] or rank[side][term] == rank[other][term] and side == 1
            if not better:
                continue
            held[other].remove(term)
        held[side].append(term)
    return {(("first", "second")[s], t) for s in (0, 1) for t in held[s]}


def test_combined_unique(spark):
    rng = np.random.default_rng(3)
    for _ in range(3):
        a, b = (list(rng.permutation([f"w{i}" for i in range(12)])) for _ in range(2))
        df = lambda x: spark.createDataFrame([(str(t), i + 1) for i, t in enumerate(x)], "term string, rank int")
        got = {(r.selection_source, r.term) for r in select.combined_unique(df(a), df(b), 6).collect()}
        assert got == brute_unique([str(t) for t in a], [str(t) for t in b], 6)


def test_folds_are_stratified(spark):
    docs = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(30)], "doc_id long, label int")
    folds = splits.stratified(docs, 5).groupBy("label", "fold").count().collect()
    assert {(r.label, r["count"]) for r in folds} == {(1, 2), (0, 4)}


def test_margin_gate():
    x, y, t = np.array([[-2.0], [-1], [1], [2]]), np.array([0, 0, 1, 1]), np.array([[-1.5], [1.5]])
    assert models.fit_predict(x, y, t, "linear", 1e-5, 1.0)[0] == "invalid_margin"
    status, decision = models.fit_predict(x, y, t, "linear", 100.0, 1.0)
    assert status == "ok" and (decision > 0).tolist() == [False, True]
    assert models.fit_predict(x, y, t, "rbf", 100.0, 1.0)[0] == "ok"


def test_metrics_guard_zero(spark):
    got = evaluate.with_metrics(evaluate.confusion(spark.createDataFrame([(0, 0)], "label int, predicted int"), [])).first()
    assert (got.accuracy, got.recall, got.precision, got.f1) == (1.0, 0.0, 0.0, 0.0)


def test_context_scores_as_columns_equal_those_by_rows(spark, monkeypatch):
    """o180_candidate_evaluation, o182_nested_cv: a term's text was shuffled once a context (2.3 GB of disk on 0.5 GB)."""
    from termforge.operators import contexts

    docs = spark.createDataFrame([(i, i % 3 % 2) for i in range(40)], "doc_id long, label int")
    posted = spark.createDataFrame([(i, f"t{k}", 1) for i in range(40) for k in range(12) if (i * 7 + k * k) % 5 < 2], "doc_id long, term string, tf long")
    roles = contexts.roles(docs, 8, 7).localCheckpoint()  # 64 contexts, two marks
    found = contexts.scored(posted, roles)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("bit_or") == 2
    got = sorted(map(tuple, found.collect()))
    monkeypatch.setattr(contexts, "MOST_COLUMNS", 0)
    assert len({r[:2] for r in got}) == 64 and got == sorted(map(tuple, contexts.scored(posted, roles).collect()))
    assert contexts.scored(posted, roles.limit(0)).count() == 0


def test_postings_cut_a_text_once(spark):
    from termforge.operators import corpus

    docs = spark.createDataFrame([(1, 1, "thunder thunder ring"), (2, 0, ""), (3, 1, "of the")], CORPUS)
    found = corpus.postings(corpus.tokens(docs))
    assert sorted(map(tuple, found.collect())) == [(1, 1, "ring", 1), (1, 1, "thunder", 2)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1  # a size asked for before the rows are made would cut the texts again
    gaps = spark.createDataFrame([(1, 1, ["a", None, "a"]), (2, 0, [])], "doc_id long, label int, toks array<string>")
    assert sorted(map(tuple, corpus.postings(gaps).collect()), key=str) == [(1, 1, "a", 2), (1, 1, None, 1)]
