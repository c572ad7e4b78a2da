"""Sparse matrices as postings doc_id, label, term, value: weights, norms, scales, vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termforge.operators import ranges


def document_frequency(posted: DataFrame) -> DataFrame:
    """term, df (and df1, df0 by label)."""
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.count_if(F.col("label") == 1).alias("df1"), F.count_if(F.col("label") == 0).alias("df0"))


def keep_frequent(posted: DataFrame, n_docs: DataFrame, min_df: float, strict: bool = False) -> DataFrame:
    """Terms with df at least min_df (a count, or a share below 1); strict: above the share."""
    df = posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    share = F.col("df") / F.col("n")
    rule = share > min_df if strict else (share >= min_df if min_df < 1 else F.col("df") >= min_df)
    return posted.join(df.crossJoin(F.broadcast(n_docs.select("n"))).filter(rule).select("term"), "term", "left_semi")


def idf(posted: DataFrame, n_docs: DataFrame) -> DataFrame:
    """Smoothed: ln((1 + n) / (1 + df)) + 1."""
    df = posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(n_docs.select("n"))).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def l2_rows(values: DataFrame, row: list[str] = ("doc_id",)) -> DataFrame:
    """value divided by the row's Euclidean norm; zero rows have no postings and stay so."""
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(W.partitionBy(*row)))
    return values.withColumn("norm", norm).withColumn("value", F.when(F.col("norm") > 0, F.col("value") / F.col("norm")).otherwise(F.lit(0.0))).drop("norm")


def tfidf(posted: DataFrame, idfs: DataFrame) -> DataFrame:
    """Terms outside idfs (the training vocabulary) drop out."""
    return l2_rows(posted.join(idfs, "term").select("doc_id", "label", "term", (F.col("tf") * F.col("idf")).alias("value")))


def relative(posted: DataFrame, lengths: DataFrame) -> DataFrame:
    """tf / len_tokens; 0 where the length is 0."""
    return posted.join(lengths.select("doc_id", "len_tokens"), "doc_id").select("doc_id", "label", "term", F.when(F.col("len_tokens") > 0, F.col("tf") / F.col("len_tokens")).otherwise(F.lit(0.0)).alias("value"))


def log_numerator(posted: DataFrame) -> DataFrame:
    return posted.select("doc_id", "label", "term", (1 + F.log("tf")).alias("value"))


def log_normalised(posted: DataFrame, lengths: DataFrame) -> DataFrame:
    """(1 + ln tf) / (1 + ln len)."""
    return posted.join(lengths.select("doc_id", "len_tokens"), "doc_id").select("doc_id", "label", "term", F.when(F.col("len_tokens") > 0, (1 + F.log("tf")) / (1 + F.log("len_tokens"))).otherwise(F.lit(0.0)).alias("value"))


def raw(posted: DataFrame) -> DataFrame:
    return posted.select("doc_id", "label", "term", F.col("tf").cast("double").alias("value"))


def select_terms(values: DataFrame, terms: DataFrame) -> DataFrame:
    return values.join(terms.select("term"), "term", "left_semi")


def column_range(values: DataFrame, n_docs: DataFrame) -> DataFrame:
    """term, low, high over all rows; absent postings are zeros."""
    seen = values.groupBy("term").agg(F.count(F.lit(1)).alias("k"), F.min("value").alias("lo"), F.max("value").alias("hi")).crossJoin(F.broadcast(n_docs.select("n")))
    gap = F.col("k") < F.col("n")
    return seen.select("term", F.when(gap, F.least("lo", F.lit(0.0))).otherwise(F.col("lo")).alias("low"), F.when(gap, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi")).alias("high"))


def min_max(values: DataFrame, ranges: DataFrame, clip: bool = True) -> DataFrame:
    """Scaled by ranges (fitted on training rows); constant columns give 0. Values of absent postings aren't listed."""
    scaled = F.when(F.col("high") > F.col("low"), (F.col("value") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(F.lit(0.0))
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled)) if clip else scaled
    return values.join(ranges, "term").select("doc_id", "label", "term", scaled.alias("value"))


def dense(values: DataFrame, docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Every document by every term of a short selected list, zeros filled in."""
    grid = docs.select("doc_id", "label").crossJoin(F.broadcast(terms.select("term")))
    return grid.join(values.select("doc_id", "term", "value"), ["doc_id", "term"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def row_min_max(grid: DataFrame) -> DataFrame:
    own = W.partitionBy("doc_id")
    lo, hi = F.min("value").over(own), F.max("value").over(own)
    return grid.withColumn("value", F.when(hi > lo, (F.col("value") - lo) / (hi - lo)).otherwise(F.lit(0.0)))


def pivot_terms(values: DataFrame, docs: DataFrame, terms: list[str], binary: bool = False) -> DataFrame:
    """A column a term; terms are named by the caller, so no extra pass finds them."""
    unit = F.when(F.col("value") > 0, F.lit(1)).otherwise(F.lit(0)) if binary else F.col("value")
    wide = values.filter(F.col("term").isin(terms)).groupBy("doc_id").agg(*[F.sum(F.when(F.col("term") == t, unit)).alias(t) for t in terms])
    return docs.select("doc_id", "label").join(wide, "doc_id", "left").na.fill(0)


def vocabulary(posted: DataFrame) -> DataFrame:
    """feature_index, term: 0-based places in sorted order, numbered by ranges (no single-task window)."""
    terms = ranges.numbered(posted.select("term").distinct(), [F.col("term")], "feature_index", 0)
    return terms.select("feature_index", "term")
