"""Numbering and running sums by ranges, statistics, selection modes, reports and caches against plain Python."""

import collections
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from termforge.functions import text as T
from termforge.operators import ranges, report, select, stats
from termforge.sources import files


def test_numbering_by_ranges(spark):
    values = random.Random(1).sample(range(10_000), 500)
    rows = spark.createDataFrame([(v,) for v in values], "v long").repartition(7)
    got = {r.v: r.n for r in ranges.numbered(rows, [F.col("v").desc()], "n").collect()}
    assert got == {v: k for k, v in enumerate(sorted(values, reverse=True), 1)}
    assert ranges.numbered(rows.limit(0), [F.col("v")], "n").count() == 0


def test_running_sums_by_ranges(spark):
    rng = random.Random(2)
    rows = [(v, rng.randint(0, 5)) for v in rng.sample(range(10_000), 300)]
    got = {r.v: r.upto for r in ranges.running(spark.createDataFrame(rows, "v long, c long").repartition(5), [F.col("v")], {"upto": "c"}).collect()}
    total = 0
    for v, c in sorted(rows):
        total += c
        assert got[v] == total


def test_quartiles_of_many_groups(spark):
    rng = np.random.default_rng(3)
    data = {g: np.round(rng.normal(size=n), 2) for g, n in (("a", 1), ("b", 2), ("c", 101), ("d", 400))}
    data["e"] = np.array([1, 2, 2, 3, 100.0])
    rows = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs] + [("a", float("nan")), ("a", None)], "grp string, v double")
    got = {r.grp: r for r in stats.iqr(rows).collect()}
    for g, vs in data.items():
        q1, q3 = np.quantile(vs, [0.25, 0.75])
        out = ((vs < q1 - 1.5 * (q3 - q1)) | (vs > q3 + 1.5 * (q3 - q1))).sum()
        assert (got[g].n, got[g].outliers) == (len(vs), out) and (got[g].q1, got[g].q3) == pytest.approx((q1, q3), abs=1e-8)
    assert (got["e"].q1, got["e"].q3, got["e"].outliers) == (2, 3, 1)


def test_curves(spark):
    data = [(0.9, 1), (0.9, 0), (0.5, 1), (0.1, 0)]
    rows = spark.createDataFrame(data, "decision double, label int")
    got = {r.decision: (r.precision, r.recall) for r in stats.precision_recall(rows).collect()}
    assert got == {0.9: (0.5, 0.5), 0.5: (pytest.approx(2 / 3), 1.0), 0.1: (0.5, 1.0)}
    assert stats.auc(rows).first().auc == pytest.approx((0.5 + 1 + 1) / 4 + 0.0)


def test_permutation_depends_on_its_seed_alone(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(int(i % 3 == 0), float(rng.integers(0, 50) + 6 * (i % 3 == 0))) for i in range(120)], "label int, v double")
    first = stats.permutation(rows, 3000).first()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        assert stats.permutation(rows.repartition(5), 3000).first() == first
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    own = rows.toPandas()
    v, y = own.v.to_numpy(), own.label.to_numpy()
    seen = v[y == 1].mean() - v[y == 0].mean()
    hits = 0
    for _ in range(20_000):
        mixed = rng.permutation(y)
        hits += abs(v[mixed == 1].mean() - v[mixed == 0].mean()) >= abs(seen) - 1e-12
    assert first.difference == pytest.approx(seen) and first.p == pytest.approx((hits + 1) / 20_001, abs=0.02)


def test_json_leaves():
    assert stats.leaf_text('{"a": "x", "b": [" ", {"c": "y"}], "n": 3}') == "x y"
    for raw in ("{}", '{"n": 1}', "[]", "12", "not json", '" "', "[" * 50_000 + "]" * 50_000):
        assert stats.leaf_text(raw) == raw
    assert stats.leaf_text(None) == "" and stats.leaf_text('"word"') == "word"


def test_japanese_words(spark):
    text = "当社は2023年3月の売上高をABC_1社とデータベースについて報告したＸｙ。カー 々〆 a"
    row = spark.createDataFrame([(text,)], "t string").select(T.japanese_tokens(F.col("t")).alias("w")).first()
    assert row.w == ["売上高", "abc_", "データベース", "報告", "カー", "々〆"]


def test_pca_of_a_line(spark):
    rows = [(i, [float(i), 2.0 * i + 0.01 * (i % 2), 0.0], int(i >= 10)) for i in range(20)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    first = stats.pca(frame, 2).orderBy("component").first()
    assert first.explained == pytest.approx(1.0, abs=1e-4) and first.reads_as == "label1_axis" and first.label1_mean > first.label0_mean
    assert first.top_loadings.startswith("1:0.894")
    scores = {r.vec_id: r.s[0] for r in stats.pca_fit(frame, 2)[0].collect()}
    assert np.corrcoef(list(scores), list(scores.values()))[0, 1] == pytest.approx(1.0, abs=1e-4)


def by_rank(table, k):
    return [t for t, _ in sorted(table.items(), key=lambda x: (-x[1], x[0]))][:k]


def scan_unique(first, second, k, second_wins_ties):
    """Two scans that take turns; a shared term goes to its better rank and the other list goes on."""
    lists = [by_rank(first, 10**6), by_rank(second, 10**6)]
    held, at, owner = [[], []], [0, 0], {}
    while any(len(h) < k // 2 for h in held):
        for i in (0, 1):
            while len(held[i]) < k // 2:
                t = lists[i][at[i]]
                at[i] += 1
                if t in owner:
                    mine, theirs = lists[i].index(t), lists[1 - i].index(t)
                    if not (mine < theirs or mine == theirs and (i == 1) == second_wins_ties):
                        continue
                    held[1 - i].remove(t)
                owner[t] = i
                held[i].append(t)
    return held


def test_selection_modes(spark):
    rng = random.Random(7)
    tables = {n: {f"t{i:02d}": rng.randint(0, 12) / 2 for i in range(30)} for n in ("term_frequency", "document_frequency", "tfidf")}
    frames = {n: spark.createDataFrame(list(t.items()), "term string, absolute_difference double") for n, t in tables.items()}
    for mode, (sources, unique) in select.MODES.items():
        rows = select.by_mode(frames, mode, 10).orderBy("selection_rank").collect()
        assert [r.selection_rank for r in rows] == list(range(1, 11)) and {r.selection_mode for r in rows} == {mode}
        got = collections.defaultdict(list)
        for r in rows:
            got[r.selection_source].append(r.term)
        if unique:
            a, b = scan_unique(tables[sources[0]], tables[sources[1]], 10, sources[1] == "document_frequency")
            order = lambda terms, n: sorted(terms, key=by_rank(tables[n], 10**6).index)  # noqa: B023, E731
            assert got[sources[0]] == order(a, sources[0]) and got[sources[1]] == order(b, sources[1])
        else:
            assert got == {n: by_rank(tables[n], 10 // len(sources)) for n in sources}
    for mode, k in (("nothing", 10), ("tfidf", 0), ("combined_unique", 9), ("combined_duplicate", 9)):
        with pytest.raises(ValueError):
            select.by_mode(frames, mode, k)
    with pytest.raises(Exception, match="fewer than"):
        select.by_mode(frames, "tfidf", 31).collect()


def test_range_join_of_thresholds(spark):
    scores = spark.createDataFrame([("a", 0.5, "label1"), ("b", 0.5, "label0"), ("c", 0.2, "label1"), ("d", 0.0, "neutral")], "term string, abs_score double, dominant_label string")
    cuts = spark.createDataFrame([(0.0,), (0.3,), (0.9,)], "score_threshold double")
    got = {(r.score_threshold, r.dominant_label): r.terms for r in select.threshold_join(scores, cuts).collect()}
    assert got == {(0.0, "label1"): 2, (0.0, "label0"): 1, (0.0, "neutral"): 1, (0.3, "label1"): 1, (0.3, "label0"): 1}


def test_display_rows_of_a_result_tree(spark, tmp_path):
    head = "feature_mode,kernel,score_threshold,mean_selected_term_count,mean_accuracy,mean_recall,mean_precision,mean_f1"
    for place, row in (("x/a", "tf,linear,0.1,12.0,0.91234,0.5,,0.7"), ("x/b", 'tf,rbf,"0.25, 0.5",12.50,0.8,0.5,0.5,0.9'), ("y", "idf,linear,,,0.5,0,1,0.2")):
        (tmp_path / place).mkdir(parents=True)
        (tmp_path / place / "svm_metrics.csv").write_text(f"{head}\n{row}\nno,no,1,1,1,1,1,1\n")
    (tmp_path / "y" / "svm_folds.csv").write_text("fold,model_feature_count\n1,10\n2,\n3,13\n")
    root = str(tmp_path)
    rows = report.display_rows(files.metric_files(spark, root), "set", {"kernel": {"linear": "Linear"}, "feature_mode": {"tf": "TF"}}, files.fold_feature_counts(spark, root))
    got = [tuple(r)[:-1] for r in report.order_rows(rows).collect()]
    assert got == [
        ("set", "-", "Linear", "TF", "0.10", "12", "0.912", "0.500", "", "0.700"),
        ("set", "-", "Linear", "idf", "", "11.5", "0.500", "0.000", "1.000", "0.200"),
        ("set", "-", "rbf", "TF", "0.25,0.50", "12.5", "0.800", "0.500", "0.500", "0.900"),
    ]
    assert [r.f1_score for r in report.order_rows(rows, 1).collect()] == ["0.900"]


def test_cache_of_a_folder(spark, tmp_path):
    folder, cache = tmp_path / "texts", str(tmp_path / "cache")
    folder.mkdir()
    (folder / "a.txt").write_text("one")
    assert [r.text for r in files.cached_texts(spark, str(folder), cache, 1).collect()] == ["one"]
    (folder / "a.txt").write_text("three")  # another size: stale
    assert [r.text for r in files.cached_texts(spark, str(folder), cache, 1).collect()] == ["three"]
    key = sorted((tmp_path / "cache").iterdir())
    files.cached_texts(spark, str(folder), cache, 1).collect()
    assert sorted((tmp_path / "cache").iterdir()) == key  # fresh: nothing is built
    files.cached_texts(spark, str(folder), cache, 2).collect()
    assert len(list((tmp_path / "cache").iterdir())) == len(key) + 1


def test_dimensions_of_a_path(spark):
    rows = spark.createDataFrame([("/out/ngram_1_2/n100/m/tf/x.csv",), ("/out/n5/m",), ("/ngram_3_3",), ("/other",)], "p string")
    got = [tuple(r) for r in rows.select(*[c.alias(n) for n, c in files.path_dimensions(F.col("p")).items()]).collect()]
    assert got == [(1, 2, 100), (None, None, 5), (3, 3, None), (None, None, None)]


def test_ranks_survive_lost_blocks(spark):
    """Rows are dealt to ranges once and written; what executors hold in between may go."""
    from termforge.operators import ranges, splits, tables

    rng = random.Random(4)
    rows = [(k, rng.randrange(50)) for k in range(400)]
    frame = spark.createDataFrame(rows, "k int, v int").withColumn("shuffled", F.rand())  # dealt anew, it would differ
    got = ranges.numbered(frame, [F.col("shuffled"), F.col("k")], "place")
    sums = ranges.running(frame, [F.col("shuffled"), F.col("k")], {"upto": "v"})
    folds = splits.stratified(frame.select(F.col("k").alias("doc_id"), (F.col("v") % 2).alias("label")), 5)
    spark.catalog.clearCache()
    places = [(r.place, r.shuffled, r.k) for r in got.collect()]
    assert sorted(p for p, _, _ in places) == list(range(1, 401)) and [x[1:] for x in sorted(places)] == sorted(x[1:] for x in places)
    total = 0
    for r in sorted(sums.collect(), key=lambda r: (r.shuffled, r.k)):
        total += r.v
        assert r.upto == total
    assert sorted(folds.groupBy("label", "fold").count().collect()) and folds.count() == 400
    tables.release()


def test_release_leaves_nothing_cached_or_written(spark, tmp_path):
    from termforge.operators import tables
    from termforge.session import shared_folder

    tables.release()
    before = spark._jsc.sc().getPersistentRDDs().size()
    kept, written = tables.kept(spark.range(100)), tables.written(spark.range(50))
    assert kept.count() == 100 and written.count() == 50
    folder = os.path.join(shared_folder(spark), "termforge-tables")
    assert spark._jsc.sc().getPersistentRDDs().size() == before + 1 and len(os.listdir(folder)) == 1
    tables.release()
    assert spark._jsc.sc().getPersistentRDDs().size() == before and not os.listdir(folder)


def test_listings_side_by_side(spark):
    from termforge.operators import corpus

    docs = spark.createDataFrame([(k, f"text {k}") for k in range(60)], "doc_id long, text string").repartition(5)
    names = spark.createDataFrame([(f"{k:03d}.txt",) for k in range(60)], "name string").repartition(7)
    got = corpus.by_position(docs, [F.col("doc_id")], names, [F.col("name")]).collect()
    assert sorted((r.doc_id, r.name) for r in got) == [(k, f"{k:03d}.txt") for k in range(60)]
    with pytest.raises(ValueError, match="60 and 59 rows"):
        corpus.by_position(docs, [F.col("doc_id")], names.filter("name <> '007.txt'"), [F.col("name")])
    assert corpus.by_position(docs.limit(0), [F.col("doc_id")], names.limit(0), [F.col("name")]).count() == 0


def test_quartiles_of_counted_values(spark):
    rng = random.Random(9)
    rows = [(g, float(rng.choice([0, 0, 0, 1, 2, 5]))) for g in "ab" for _ in range(60)]
    counts = [(g, v, c) for (g, v), c in collections.Counter(rows).items()]
    plain = stats.iqr(spark.createDataFrame(rows, "grp string, v double")).collect()
    counted = stats.iqr(spark.createDataFrame(counts, "grp string, v double, c long")).collect()
    assert sorted(map(repr, plain)) == sorted(map(repr, counted)) and len(plain) == 2
