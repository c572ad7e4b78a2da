"""The thin queries opN_<name>: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.llm import bpe, decontaminate, filter_audit, lm_score, mixing, near_dup, passage_chain, periodic_runs, pii, quality_rules, sharding, suffix_dedup, toxicity
from termforge.llm._store import documents


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(documents(spark, sf_dir)).drop("rejected_by")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(documents(spark, sf_dir), toxicity.remainder(F.col("doc_id"), 7) != 2)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(documents(spark, sf_dir))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_chain.passages(documents(spark, sf_dir))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(documents(spark, sf_dir)).select("doc_id", "shard")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = mixing.domains(documents(spark, sf_dir, "labels"))
    found = mixing.rates(documents(spark, sf_dir), labels, mixing.TARGETS, "doc_id")
    return found.select(
        "doc_id",
        F.col("tokens").alias("n_tokens"),
        *[F.get("p", F.lit(k)).alias(f"p{k}") for k in range(len(mixing.TARGETS))],
        "rate",
        mixing.times(F.col("rate"), F.col("doc_id")).alias("copies"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), documents(spark, sf_dir, "labels")
    found = toxicity.score(docs, labels.filter(toxicity.remainder(F.col("doc_id"), 4) != 2))
    return found.select(
        "doc_id", (toxicity.remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir))
    at = F.arrays_zip("kinds", "starts", "ends")
    said = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kinds"], x["starts"], x["ends"])), ",")
    count = lambda k: F.size(F.filter("kinds", lambda x: x == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *[count(k) for k in pii.KINDS],
        F.sha2(said(F.filter(at, lambda x: x["kinds"] != "term")).cast("binary"), 256).alias("base_sha256"),
        said(at).alias("spans"),
    )


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    found = bpe.decode(bpe.encode(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN, "doc_id"), ranks)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = documents(spark, sf_dir, "labels")
    return filter_audit.audit(documents(spark, sf_dir), labels.select("doc_id", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = periodic_runs.detect(docs.select("doc_id", periodic_runs.planted(F.col("text"), F.col("doc_id")).alias("text")), "doc_id")
    said = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), said.alias("said"), "collapsed")
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return rows.select(
        "doc_id",
        "n_runs",
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join("said", "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_lm_score": op2_lm_score,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_near_dup": op5_near_dup,
    "op6_passages": op6_passages,
    "op7_sharding": op7_sharding,
    "op8_mixing": op8_mixing,
    "op9_toxicity": op9_toxicity,
    "op10_pii": op10_pii,
    "op11_bpe": op11_bpe,
    "op12_filter_audit": op12_filter_audit,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS body FROM documents),
w AS (SELECT k, list_filter(string_split_regex(body, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
u AS (SELECT k, unnest(range(1, greatest(len(ws) - 1, 1))) AS i, ws FROM w WHERE len(ws) >= 3),
g AS (SELECT k, i, count(*) OVER (PARTITION BY k, ws[i], ws[i + 1], ws[i + 2]) AS c FROM u),
r AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM g WHERE c > 1) GROUP BY k),
m AS (SELECT d.doc_id, body, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
      FROM d JOIN w USING (k) LEFT JOIN r USING (k)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols > 0.25 * n_words
            OR length(body) - length(replace(body, '!', '')) > 0.3 * n_words
            OR length(body) - length(regexp_replace(body, '\p{Lu}', '', 'g')) > 0.6 * word_chars
            OR word_chars < 2 * n_words OR word_chars > 40 * n_words
            OR 2 * n_dup_lines > 1 + length(body) - length(replace(body, chr(10), ''))) AS kept
FROM b""",
    "op12_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body FROM documents),
w AS (SELECT doc_id, part, body, list_filter(string_split_regex(body, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             min(doc_id) OVER (PARTITION BY body) AS first FROM d),
m AS (SELECT doc_id, part, [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws),
             100 * (length(body) - length(regexp_replace(body, '[A-Z]', '', 'g'))) > 10 * length(body),
             regexp_matches(body, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (l.good) AS good, count(*) FILTER (l.toxic) AS toxic
      FROM m LEFT JOIN l USING (doc_id) GROUP BY part, fails),
f AS (SELECT unnest(range(1, 6)) AS f),
o AS (SELECT [a.f, b.f, g.f, h.f, i.f] AS o FROM f a, f b, f g, f h, f i WHERE len(list_distinct([a.f, b.f, g.f, h.f, i.f])) = 5),
s AS (SELECT o, f.f AS step, o[f.f] AS f FROM o, f),
x AS (SELECT part, array_to_string(list_transform(o, lambda k: substr('ABCDE', k, 1)), '') AS filter_order, step, f, fails, n, good, toxic,
             fails[f] AS own, list_bool_or(list_transform(o[1:step - 1], lambda k: fails[k])) AS gone FROM s, c),
r AS (SELECT part, filter_order, step, f, CAST(coalesce(sum(n) FILTER (NOT own AND NOT coalesce(gone, false)), 0) AS BIGINT) AS kept,
             CAST(coalesce(sum(n) FILTER (own AND NOT coalesce(gone, false)), 0) AS BIGINT) AS removed,
             CAST(coalesce(sum(n) FILTER (own AND gone), 0) AS BIGINT) AS redundant,
             CAST(coalesce(sum(n) FILTER (own AND len(list_filter(fails, lambda y: y)) = 1), 0) AS BIGINT) AS unique_fails,
             CAST(coalesce(sum(good) FILTER (own AND NOT coalesce(gone, false)), 0) AS BIGINT) AS good_lost,
             CAST(coalesce(sum(toxic) FILTER (own AND NOT coalesce(gone, false)), 0) AS BIGINT) AS toxic_lost
      FROM x GROUP BY part, filter_order, step, f)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r""",
}
