"""Result rows as they are shown: labels, number formats, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed(value: Column, digits: int = 3) -> Column:
    """A number's text with so many decimals; what isn't a number is blank."""
    number = value.try_cast("double")
    return F.when(number.isNotNull(), F.format_string(f"%.{digits}f", number)).otherwise(F.lit(""))


def shortest(value: Column, decimals: int = 1) -> Column:
    """As fixed, without zeros at the end."""
    return F.regexp_replace(F.regexp_replace(fixed(value, decimals), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def thresholds(value: Column) -> Column:
    """Each of the comma-separated thresholds with two decimals."""
    parts = F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), F.trim), lambda x: x != "")
    return F.array_join(F.transform(parts, lambda x: fixed(x, 2)), ",")


def named(value: Column, labels: dict[str, str]) -> Column:
    """The label of a known name; other names stay."""
    out = F.coalesce(value, F.lit(""))
    for name, label in labels.items():
        out = F.when(value == name, F.lit(label)).otherwise(out)
    return out


def display_rows(metrics: DataFrame, dataset: str, labels: dict[str, dict[str, str]], fold_counts: DataFrame | None = None) -> DataFrame:
    """One row a metrics row (strings; path and the columns of a metrics file): dataset, word_count_mode, kernel,
    feature_mode, score_threshold, mean_feature_count, accuracy, recall, precision, f1_score, path.

    labels: by column the shown names. fold_counts (folder, model_feature_count) names the mean of a
    result's folds, which goes before its mean_selected_term_count. Order: order_rows().
    """
    have = set(metrics.columns)
    col = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    rows = metrics.withColumn("_folder", F.regexp_replace("path", "/[^/]*$", ""))
    if fold_counts is not None:
        rows = rows.join(fold_counts.select(F.col("folder").alias("_folder"), F.col("model_feature_count").alias("_folds")), "_folder", "left")
    else:
        rows = rows.withColumn("_folds", F.lit(None).cast("double"))
    own = F.nullif(col("candidate_score_thresholds"), F.lit(""))
    count = F.when(F.col("_folds").isNotNull(), fixed(F.col("_folds"), 1)).otherwise(shortest(col("mean_selected_term_count")))
    mode = F.nullif(col("word_count_mode"), F.lit(""))
    return rows.select(
        F.lit(dataset).alias("dataset"), F.when(mode.isNull(), "-").otherwise(named(mode, labels.get("word_count_mode", {}))).alias("word_count_mode"),
        named(col("kernel"), labels.get("kernel", {})).alias("kernel"), named(col("feature_mode"), labels.get("feature_mode", {})).alias("feature_mode"),
        thresholds(F.coalesce(own, col("score_threshold"))).alias("score_threshold"), count.alias("mean_feature_count"),
        *[fixed(col(f"mean_{m}")).alias(n) for m, n in (("accuracy", "accuracy"), ("recall", "recall"), ("precision", "precision"), ("f1", "f1_score"))], "path")


def order_rows(rows: DataFrame, top: int = 0) -> DataFrame:
    """Sorted by dataset, mode, kernel, feature, first threshold, F1; with `top` only the rows of highest F1."""
    number = lambda c: F.coalesce(c.try_cast("double"), F.lit(-1.0))
    own = rows.orderBy(number(F.col("f1_score")).desc(), "path").limit(top) if top > 0 else rows
    return own.orderBy("dataset", "word_count_mode", "kernel", "feature_mode", number(F.get(F.split("score_threshold", ","), F.lit(0))), number(F.col("f1_score")), "path")
