"""Tokenizers, models and caches that users bring; JSON leaves as a table function; document vectors."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from termforge.operators import extensions, models, native_models, stats
from termforge.plans import registry
from termforge.sources import files

SF = "/root/testdata/sf0.001"


def test_a_second_tokenizer_through_the_same_queries(spark):
    plain = {r.term for r in registry.QUERIES["o81_score_table"](spark, SF).collect()}
    with extensions.using(tokenizer="white_space"):
        other = {r.term for r in registry.QUERIES["o81_score_table"](spark, SF).collect()}
        assert registry.QUERIES["o43_tfidf"](spark, SF).head() is not None
    assert other != plain and any(len(t) > 15 for t in other) and all(len(t) <= 15 for t in plain)
    extensions.register_tokenizer("pairs of letters", lambda text, min_len=2: F.regexp_extract_all(F.lower(text), F.lit("([a-z]{2})"), F.lit(1)))
    with extensions.using(tokenizer="pairs of letters"):
        assert all(len(r.term) == 2 for r in registry.QUERIES["o81_score_table"](spark, SF).collect())
    assert {r.term for r in registry.QUERIES["o81_score_table"](spark, SF).collect()} == plain
    with pytest.raises(ValueError, match="no tokenizer"), extensions.using(tokenizer="none"):
        pass
    with pytest.raises(ValueError, match="is known"):
        extensions.register_tokenizer("alphabetic", lambda text, n: text)


def test_a_second_model_through_the_same_selection(spark):
    rng = random.Random(1)
    rows = [(o, i, d, "test" if d % 3 == max(i, 0) else "train", d % 2, [d % 2 + 0.2 * rng.random(), rng.random()]) for o in (0, 1) for i in (-1, 0, 1) for d in range(30)]
    frame = spark.createDataFrame(rows, "outer_fold int, inner_fold int, doc_id long, role string, label int, features array<double>")

    def centroid(x, y, xt, g):
        a, b = x[y == 1].mean(0), x[y == 0].mean(0)
        at = lambda z: g["c"] * ((z - b) ** 2).sum(1) - g["c"] * ((z - a) ** 2).sum(1)
        return at(x), at(xt)

    records, statuses = models.candidate_records(frame, models.grid(spark, {"c": [0.01, 10.0]}), 0.999, run=extensions.model(centroid))
    assert {r.candidate_index: r.status for r in statuses.collect()} == {0: "dropped", 1: "valid"}
    best = models.select_best(records).collect()
    assert sorted((r.outer_fold, r.candidate_index, r.accuracy) for r in best) == [(0, 1, 1.0), (1, 1, 1.0)]


def test_contexts_are_cached_by_content(spark, tmp_path):
    folder = str(tmp_path / "contexts")
    with extensions.using(cache=folder):
        first = sorted(map(tuple, registry.QUERIES["o173_svc_linear"](spark, SF).collect()))
        (key,) = os.listdir(folder)
        stamp = os.stat(f"{folder}/{key}/_SUCCESS").st_mtime_ns
        again = sorted(map(tuple, registry.QUERIES["o173_svc_linear"](spark, SF).collect()))
        assert os.listdir(folder) == [key] and os.stat(f"{folder}/{key}/_SUCCESS").st_mtime_ns == stamp
    assert first == again == sorted(map(tuple, registry.QUERIES["o173_svc_linear"](spark, SF).collect()))


def test_a_write_killed_half_way_is_never_read(spark, tmp_path):
    folder, calls = str(tmp_path / "cache"), []

    def broken():
        calls.append("broken")
        return spark.range(10, numPartitions=4).select(F.when(F.col("id") < 9, F.col("id")).otherwise(F.raise_error(F.lit("killed"))).alias("id"))

    def whole():
        calls.append("whole")
        return spark.range(10)

    with pytest.raises(Exception, match="killed"):
        files.cached(spark, folder, "k", broken)
    assert not os.path.exists(f"{folder}/k") and not [f for f in os.listdir(folder) if not f.startswith(".")]
    assert files.cached(spark, folder, "k", whole).count() == 10 == files.cached(spark, folder, "k", broken).count()
    assert calls == ["broken", "whole"]


def test_content_keys(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "doc_id long, text string")
    key = files.content_key({"k": 3, "folds": [1, 2]}, rows)
    assert key == files.content_key({"folds": [1, 2], "k": 3}, rows.select("text", "doc_id").repartition(3))
    others = [({"k": 4, "folds": [1, 2]}, rows), ({"k": 3, "folds": [1, 2]}, rows.distinct()), ({"k": 3, "folds": [1, 2]}, rows.limit(0)), ({"k": 3, "folds": [1, 2]}, rows.withColumn("doc_id", F.col("doc_id").cast("int")))]
    assert len({key, *(files.content_key(*o) for o in others)}) == 5


def test_json_leaves_as_rows(spark):
    texts = ['{"a": "x", "b": [" ", {"c": "y"}], "n": 3}', '"only"', "[]", "no json", None, "", '["p", ["q"]]']
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, props string")
    got = sorted(map(tuple, extensions.json_leaf_rows(rows, "props").collect()))
    assert got == [(0, "$.a", 0, "x"), (0, "$.b[1].c", 1, "y"), (1, "$", 0, "only"), (6, "$[0]", 0, "p"), (6, "$[1][0]", 1, "q")]
    spark.udtf.register("json_leaves", extensions.JsonLeaves)
    rows.createOrReplaceTempView("some_json")
    assert spark.sql("SELECT id, path, leaf FROM some_json, LATERAL json_leaves(props)").count() == 5


def test_words_of_one_topic_are_near(spark):
    rng = random.Random(2)
    topics = [[f"{t}{k}" for k in range(8)] for t in ("ship", "bread")]
    docs = [(d, d % 2, [rng.choice(topics[d % 2]) for _ in range(40)]) for d in range(160)] + [(999, 0, ["unseen"])]
    vectors, words = native_models.document_vectors(spark.createDataFrame(docs, "doc_id long, label int, toks array<string>"), 10, rounds=3)
    own = {r.word: np.array(r.vector) for r in words.collect()}
    assert "unseen" not in own and len(own) == 16
    near = lambda w: max((x for x in own if x != w), key=lambda x: own[w] @ own[x] / np.linalg.norm(own[w]) / np.linalg.norm(own[x]))
    assert all(near(w)[:4] == w[:4] for w in own)
    found = stats.nearest_centroid(vectors.filter("vec_id < 999")).collect()
    assert all(r.predicted == r.actual for r in found)
    assert vectors.filter("vec_id = 999").first().embedding == [0.0] * 10
