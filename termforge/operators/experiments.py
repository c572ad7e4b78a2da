"""Experiments over score thresholds: each fixed, or one more parameter that the inner folds choose."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termforge.operators import contexts, models
from termforge.operators.corpus import r9


def threshold_records(posted: DataFrame, roles: DataFrame, thresholds: list[float], candidates: DataFrame, most_terms: int, margin: float | None = models.MARGIN, tol: float = models.TOLERANCE, seconds: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, statuses) of models.candidate_records for every threshold, with the columns score_threshold and
    param_label 'threshold=..., ...'; a threshold's terms are those of each context's training rows at or above it,
    the best most_terms of them."""
    records = statuses = None
    for t in thresholds:  # a parameter list, one plan each
        rows = contexts.features(posted, roles, contexts.selected(posted, roles, most_terms, t), most_terms)
        label = F.concat(F.lit(f"threshold={t:g}, "), "param_label")
        own = [x.withColumns({"score_threshold": F.lit(float(t)), "param_label": label}) for x in models.candidate_records(rows, candidates, margin, tol=tol, seconds=seconds)]
        records = own[0] if records is None else records.unionByName(own[0])
        statuses = own[1] if statuses is None else statuses.unionByName(own[1])
    return records, statuses


def summary(best: DataFrame, by: list[str]) -> DataFrame:
    """Macro means over the outer folds and the chosen parameters in fold order."""
    chosen = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("outer_fold", "param_label"))), lambda x: x["param_label"]), "; ")
    return best.groupBy(*by).agg(F.count(F.lit(1)).alias("folds"), *[r9(F.avg(m)).alias(f"mean_{m}") for m in ("accuracy", "recall", "precision", "f1")], chosen.alias("best_params"))


def fixed_and_tuned(records: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Summaries of each fixed threshold and of the tuned one (mode, score_threshold; null when tuned);
    thresholds (score_threshold) without a valid candidate stay with no folds."""
    each = None
    for t in [r[0] for r in thresholds.collect()]:  # the parameter list
        own = models.select_best(records.filter(F.col("score_threshold") == t))
        each = own if each is None else each.unionByName(own)
    fixed = thresholds.join(summary(each, ["score_threshold"]), "score_threshold", "left").withColumn("mode", F.lit("fixed"))
    tuned = summary(models.select_best(records).withColumn("mode", F.lit("tuned")), ["mode"]).withColumn("score_threshold", F.lit(None).cast("double"))
    return fixed.withColumn("folds", F.coalesce("folds", F.lit(0))).unionByName(tuned)
