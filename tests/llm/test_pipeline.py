"""The corpus pipeline, stage by stage, each on its predecessor's rows against brute force."""

import collections

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from termforge.llm import mixing, queries
from termforge.llm._store import documents, keep, made
from tests.llm.test_queries import SF, brute_classes, contaminated, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    out, docs = [documents(spark, SF)], documents(spark, SF)
    for _, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, SF))
        out.append(docs)
    return [[r.asDict() for r in d.collect()] for d in out]


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "source_mix", "sharding"]


def test_quality_rules(stages):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    good = {r[0] for r in db.execute(f"SELECT doc_id FROM ({queries.ORACLE_SQL['op1_quality_rules']}) WHERE kept").fetchall()}
    assert list(stages[1][0]) == COLUMNS and {r["doc_id"] for r in stages[1]} == good and len(stages[1]) == len(good) < len(stages[0])
    before = {r["doc_id"]: r for r in stages[0]}
    assert all(r == before[r["doc_id"]] for r in stages[1])


def test_near_duplicates(stages):
    want = brute_classes({r["doc_id"]: r["text"] for r in stages[1]})
    assert sorted(r["doc_id"] for r in stages[2]) == sorted(set(want.values())) and len(stages[2]) < len(stages[1])
    before = {r["doc_id"]: r for r in stages[1]}
    assert all(r == before[r["doc_id"]] for r in stages[2])


def test_decontamination(stages):
    before, after = ({r["doc_id"]: r for r in s} for s in stages[2:4])
    touched = 0
    for i, words, hit, _ in contaminated({i: r["text"] for i, r in before.items()}, table("benchmark")):
        if not hit:
            assert after[i] == before[i]
        elif len(hit) > 0.5 * len(words):
            assert i not in after
        else:
            touched += 1
            ((_, left, _, _),) = contaminated({i: after[i]["text"]}, [])
            assert left == [w for k, w in enumerate(words) if k not in hit]
            assert after[i]["n_chars"] == len(after[i]["text"])
    assert touched


def test_source_mix(stages, spark):
    rates = {r.doc_id: r for r in mixing.rates(spark.createDataFrame(stages[3]), mixing.domains(documents(spark, SF, "labels")), mixing.TARGETS, "doc_id").collect()}
    copies = collections.Counter(r["doc_id"] for r in stages[4])
    tokens = sum(r.tokens for r in rates.values())
    # the least squares over rates of 0 and more, by very many plain steps
    n, p = np.array([r.tokens for r in rates.values()], float), np.array([r.p for r in rates.values()])
    whiten, goal = mixing.whitening((p * n[:, None]).T @ p), np.array(mixing.TARGETS) * tokens
    loss = lambda rate: ((g := (rate * n) @ p - goal) @ whiten @ g + 0.01 * n @ (rate - 1) ** 2) / tokens
    rate = np.ones(len(n))
    for _ in range(20_000):
        rate = np.maximum(0, rate - (p @ whiten @ ((rate * n) @ p - goal) + 0.01 * (rate - 1)) / 1.01)
    own = np.array([r.rate for r in rates.values()])
    print("largest rate", own.max(), "reached", (own * n) @ p / tokens, "loss", loss(own), loss(rate), loss(np.ones(len(n))))
    assert own.max() < 30  # nothing runs away, though the targets can't be met on so few rows
    assert loss(own) <= 1.02 * loss(rate) + 1e-6 < loss(np.ones(len(n)))
    for i, r in rates.items():
        assert copies[i] in (int(r.rate), int(r.rate) + 1)
    before = {r["doc_id"]: r for r in stages[3]}
    assert all(r == before[r["doc_id"]] for r in stages[4])


def test_sharding(stages):
    assert list(stages[5][0]) == [*COLUMNS, "shard"] and len(stages[5]) == len(stages[4])
    by = collections.defaultdict(set)
    for r in stages[5]:
        by[r["doc_id"]].add(r["shard"])
    assert all(len(s) == 1 and 0 <= min(s) < 64 for s in by.values())


def test_run_is_the_stages_and_leaves_one_table(stages, spark):
    before = made()
    rows = [r.asDict() for r in corpus_pipeline.run(spark, SF).collect()]
    key = lambda r: (r["doc_id"], r["shard"])
    assert sorted(map(key, rows)) == sorted(map(key, stages[5]))
    assert len(made() - before) == 1  # the last stage's input, which the lazy result reads


def test_empty_and_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, rank int, shard string, label double"
    good = " ".join(f"word{k}" for k in range(80))
    odd = [(1, None), (2, ""), (None, good + " nameless"), (3, good), (3, good), (3, good + " " + good.upper()), (4, " ".join(f"other{k % 97}x{k}" for k in range(90)))]
    for name, rows in (("odd", odd), ("empty", [])):
        spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x", 0.5) for i, t in rows], schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(3, 1, 0), (4, 0, 1), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame([(1, "none of it")], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    docs = documents(spark, f"{tmp_path}/odd")
    first = corpus_pipeline.quality(spark, docs, f"{tmp_path}/odd").collect()
    assert collections.Counter(r.doc_id for r in first) == {3: 3, 4: 1, None: 1}  # no words: gone
    one = corpus_pipeline.near_duplicates(spark, documents(spark, f"{tmp_path}/odd"), f"{tmp_path}/odd").collect()
    assert collections.Counter(r.doc_id for r in one) == {1: 1, 2: 1, 3: 2, 4: 1}  # the nameless copy of 3 goes, its two texts stay
    found = corpus_pipeline.run(spark, f"{tmp_path}/odd")
    assert found.columns[:3] == ["doc_id", "text", "lang"] and {"rank", "label", "shard"} <= set(found.columns)
    assert {r.doc_id for r in found.collect()} <= {3, 4}
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
