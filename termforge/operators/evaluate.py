"""Metrics over predictions: conditional counts, guarded ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termforge.operators.corpus import r9


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(preds: DataFrame, by: list[str]) -> DataFrame:
    cell = lambda y, p: F.count_if((F.col("label") == y) & (F.col("predicted") == p))
    return preds.groupBy(*by).agg(cell(1, 1).alias("tp"), cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"))


def with_metrics(counts: DataFrame) -> DataFrame:
    tp, tn, fp, fn = map(F.col, ("tp", "tn", "fp", "fn"))
    return counts.withColumns({
        "accuracy": r9(ratio(tp + tn, tp + tn + fp + fn)), "recall": r9(ratio(tp, tp + fn)), "precision": r9(ratio(tp, tp + fp)), "f1": r9(ratio(2 * tp, 2 * tp + fp + fn))})


def gated(rows: DataFrame, models: DataFrame, candidates: DataFrame, fitted: Column, decision: Column, converged: Column, margin: float | None, accuracy: bool) -> DataFrame:
    """One row a test row of a context and candidate: outer_fold, inner_fold, candidate_index, param_label, doc_id,
    label, status, decision, predicted.

    models: outer_fold, inner_fold, candidate_index and what `fitted`, `decision` and `converged` read, one a context and
    candidate at most; they are broadcast. Status: one_class (no model), invalid_margin (a training row's signed
    decision is below `margin`), invalid_accuracy (with `accuracy`, a training row is predicted wrongly),
    not_converged or ok.
    """
    by = ["outer_fold", "inner_fold"]
    every = rows.select(*by).distinct().crossJoin(F.broadcast(candidates)).join(models, [*by, "candidate_index"], "left")
    scored = rows.join(F.broadcast(every), by).withColumns({"fitted": fitted, "decision": F.when(fitted, decision).otherwise(F.lit(0.0)), "converged": F.coalesce(converged, F.lit(False))})
    signed = F.when(F.col("label") == 1, F.col("decision")).otherwise(-F.col("decision"))
    right = (F.col("decision") > 0) == (F.col("label") == 1)
    train = scored.filter("role = 'train'").groupBy(*by, "candidate_index").agg(F.min(signed).alias("least"), F.bool_and(right).alias("right"))
    test = scored.filter("role = 'test'").join(F.broadcast(train), [*by, "candidate_index"], "left")
    status = F.when(~F.col("fitted"), "one_class")
    if margin is not None:
        status = status.when(F.col("least") < F.lit(margin), "invalid_margin")
    if accuracy:
        status = status.when(~F.col("right"), "invalid_accuracy")
    status = status.when(~F.col("converged"), "not_converged").otherwise("ok")
    return test.select(*by, "candidate_index", "param_label", "doc_id", "label", status.alias("status"), "decision", F.when(F.col("decision") > 0, 1).otherwise(0).alias("predicted"))
