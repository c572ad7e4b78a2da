"""Deterministic splits: fold = place within the label, in doc_id order, modulo the number of folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termforge.operators.tables import written


def stratified(docs: DataFrame, k: int, fold: str = "fold", by: list[str] = ()) -> DataFrame:
    """docs (doc_id, label) with the column fold. Rows are ids and labels only; they're numbered by
    ranges of doc_id, so no task sees all rows of a label. The dealt rows are written: rows and range
    sizes must see the same ranges, also after the loss of an executor."""
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    group = [*by, "label"]
    placed = written(docs.repartitionByRange(parts, "doc_id").withColumn("_part", F.spark_partition_id()))
    own = placed.withColumn("_own", F.row_number().over(W.partitionBy("_part", *group).orderBy("doc_id")))
    sizes = placed.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_k"))
    before = sizes.withColumn("_before", F.sum("_k").over(W.partitionBy(*group).orderBy("_part")) - F.col("_k")).drop("_k")
    return own.join(F.broadcast(before), ["_part", *group]).withColumn(fold, ((F.col("_before") + F.col("_own") - 1) % k).cast("int")).drop("_part", "_own", "_before")


def nested(docs: DataFrame, outer: int, inner: int) -> DataFrame:
    """doc_id, label, outer_fold, inner_fold, role for each outer fold: train rows are numbered again inside it."""
    folds = stratified(docs, outer, "test_fold")
    each = folds.withColumn("outer_fold", F.explode(F.sequence(F.lit(0), F.lit(outer - 1))))
    train = stratified(each.filter("test_fold <> outer_fold").drop("test_fold"), inner, "inner_fold", ["outer_fold"]).withColumn("role", F.lit("train"))
    test = each.filter("test_fold = outer_fold").drop("test_fold").withColumns({"inner_fold": F.lit(-1), "role": F.lit("test")})
    return train.unionByName(test)


def holdout(docs: DataFrame, percent: int, salt: str = "split") -> DataFrame:
    """train / validation / test by a hash of doc_id: percent to train, the rest halved."""
    h = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(salt), F.col("doc_id").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(100))
    cut = percent + (100 - percent) // 2
    return docs.withColumn("role", F.when(h < percent, "train").when(h < cut, "validation").otherwise("test"))


def leave_one_out(docs: DataFrame) -> DataFrame:
    """test_id, test_label of every split, with the corpus's class sizes n1, n0, n; a split's training
    rows are all others and aren't listed. For the listed contexts of a small corpus see contexts.leave_one_out."""
    sizes = docs.agg(F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label") == 0).alias("n0"), F.count(F.lit(1)).alias("n"))
    return docs.select(F.col("doc_id").alias("test_id"), F.col("label").alias("test_label")).crossJoin(F.broadcast(sizes))


def stratified_holdout(docs: DataFrame, one_in: int = 10) -> DataFrame:
    """train and test with every one_in-th document of each label in the test part."""
    folds = stratified(docs, one_in)
    return folds.withColumn("role", F.when(F.col("fold") == 0, "test").otherwise("train")).drop("fold")
