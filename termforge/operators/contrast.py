"""Label contrasts: how a term's values differ between label 1 and label 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termforge.operators.corpus import r9


def by_label(values: DataFrame, value: str = "value") -> DataFrame:
    """term, s1, s0: sums by label; one pass, partial sums before the shuffle."""
    v = F.col(value).cast("double")
    return values.groupBy("term").agg(F.sum(F.when(F.col("label") == 1, v).otherwise(F.lit(0.0))).alias("s1"), F.sum(F.when(F.col("label") == 0, v).otherwise(F.lit(0.0))).alias("s0"))


def difference_table(values: DataFrame, sizes: DataFrame | None, metric: str) -> DataFrame:
    """The metric's table; with class sizes the sums become means over all documents of the class."""
    sums = by_label(values)
    if sizes is not None:
        sums = sums.crossJoin(F.broadcast(sizes)).select("term", (F.col("s1") / F.col("n1")).alias("s1"), (F.col("s0") / F.col("n0")).alias("s0"))
    diff = F.col("s1") - F.col("s0")
    return sums.select(
        F.lit(metric).alias("metric_id"),
        "term",
        r9(F.col("s1")).alias("label1_value"),
        r9(F.col("s0")).alias("label0_value"),
        r9(diff).alias("difference"),
        r9(F.abs(diff)).alias("absolute_difference"),
        F.when(r9(diff) >= 0, 1).otherwise(0).alias("larger_label"),
        F.when(r9(diff) > 0, "label1").when(r9(diff) < 0, "label0").otherwise("neutral").alias("dominant_label"),
    )


def score_table(posted: DataFrame, sizes: DataFrame) -> DataFrame:
    """Document-count scores: share of label-1 documents with the term minus share of label-0 ones, and 12 more columns."""
    df = posted.groupBy("term").agg(F.count_if(F.col("label") == 1).alias("c1"), F.count_if(F.col("label") == 0).alias("c0")).crossJoin(F.broadcast(sizes))
    s = r9(F.col("c1") / F.col("n1") - F.col("c0") / F.col("n0"))
    pick = lambda a, b, c: F.when(s > 0, a).when(s < 0, b).otherwise(c)
    return df.select(
        "term",
        F.col("c1").alias("label1_doc_count"),
        F.col("c0").alias("label0_doc_count"),
        F.col("n1").alias("label1_total_docs"),
        F.col("n0").alias("label0_total_docs"),
        s.alias("label1_score"),
        (F.lit(0.0) - s).alias("label0_score"),
        F.abs(s).alias("abs_score"),
        pick(F.lit("label1"), F.lit("label0"), F.lit("neutral")).alias("dominant_label"),
        pick(F.lit("label1_score"), F.lit("label0_score"), F.lit("")).alias("selected_score_source"),
        F.abs(s).alias("selected_score"),
        (F.col("c1") - F.col("c0")).alias("doc_count_diff_label1_minus_label0"),
        (F.col("c0") - F.col("c1")).alias("doc_count_diff_label0_minus_label1"),
    )


def scout_table(posted: DataFrame, weights: DataFrame, sizes: DataFrame) -> DataFrame:
    """Mean tf-idf, total and mean counts, document counts and rates by label, and their differences both ways."""
    counts = posted.groupBy("term").agg(
        *[F.sum(F.when(F.col("label") == k, F.col("tf")).otherwise(0)).alias(f"label{k}_total_count") for k in (1, 0)],
        *[F.count_if(F.col("label") == k).alias(f"label{k}_doc_count") for k in (1, 0)],
    )
    w = by_label(weights)
    rows = counts.join(w, "term").crossJoin(F.broadcast(sizes))
    for k in (1, 0):
        n = F.greatest(F.col(f"n{k}"), F.lit(1))
        rows = rows.withColumns({f"label{k}_mean_tfidf": r9(F.col(f"s{k}") / n), f"label{k}_mean_count": r9(F.col(f"label{k}_total_count") / n), f"label{k}_doc_rate": r9(F.col(f"label{k}_doc_count") / n)})
    names = ["mean_tfidf", "total_count", "doc_count", "mean_count", "doc_rate"]
    out = ["term"]
    for m in names:
        one, zero = F.col(f"label1_{m}"), F.col(f"label0_{m}")
        d = (lambda x: x) if m.endswith(("total_count", "doc_count")) else r9
        out += [one, zero, d(one - zero).alias(f"label1_{m}_minus_label0_{m}"), d(zero - one).alias(f"label0_{m}_minus_label1_{m}")]
    return rows.select(*out)
