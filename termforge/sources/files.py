"""Corpora and result trees from files, read by Spark's own readers; sinks and a fingerprinted cache."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.functions import text as T
from termforge.operators.corpus import map_labels, union_corpora


def resolve_datasets(names: list[str]) -> tuple[str, str]:
    """Exactly two non-empty folder names, label 1 first."""
    own = [n.strip() for n in names if n and n.strip()]
    if len(own) != 2 or len(names) != 2:
        raise ValueError("exactly two dataset names are needed")
    return own[0], own[1]


def text_folder(spark: SparkSession, path: str) -> DataFrame:
    """doc_name, text: one row a .txt file (any case), byte order mark dropped."""
    rows = spark.read.option("pathGlobFilter", "*.[tT][xX][tT]").text(path, wholetext=True)
    return rows.select(T.display_name(F.col("_metadata.file_name")).alias("doc_name"), F.regexp_replace("value", "^\ufeff", "").alias("text"))


def labelled_folders(spark: SparkSession, positive: str, negative: str) -> DataFrame:
    return union_corpora(text_folder(spark, positive), text_folder(spark, negative))


def csv_corpus(spark: SparkSession, path: str, text: str, label: str, mapping: dict[str, int]) -> DataFrame:
    """text, label: only these two columns are read; rows without either are dropped, unknown labels are errors."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).select(F.col(text).alias("text"), F.col(label).alias("label"))
    return map_labels(rows.filter(F.col("text").isNotNull()), "label", mapping)


def write_csv(rows: DataFrame, path: str) -> None:
    """One file with a header after a byte order mark, for small reports."""
    marked = rows.withColumnRenamed(rows.columns[0], "\ufeff" + rows.columns[0])
    marked.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def result_tree(spark: SparkSession, path: str) -> DataFrame:
    """First row of each n<k>/m/<selection>/<feature>/<kernel>/svm_metrics.csv, its folders as columns."""
    rows = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "svm_metrics.csv").csv(path)
    found = rows.withColumn("_at", F.struct(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("id")))
    at, pattern = F.col("_at.path"), r"/n(\d+)/m/([^/]+)/([^/]+)/([^/]+)/svm_metrics\.csv$"
    parts = {n: F.regexp_extract(at, pattern, i + 1) for i, n in enumerate(("feature_count", "selection_mode", "feature_mode", "kernel"))}
    first = found.groupBy("_at.path").agg(F.min_by(F.struct(*rows.columns), "_at.id").alias("r"), F.first("_at").alias("_at"))
    others = [c for c in rows.columns if c not in parts]
    return first.select(*[e.alias(n) for n, e in parts.items()], *[F.col(f"r.{c}").alias(c) for c in others])


def path_dimensions(path: Column) -> dict[str, Column]:
    """What a result's path says: min_n and max_n of ngram_<min>_<max>, feature_count of n<k>; null where it doesn't."""
    part = lambda pattern, i: F.regexp_extract(path, pattern, i).try_cast("int")
    return {"min_n": part(r"(?:^|/)ngram_(\d+)_(\d+)(?:/|$)", 1), "max_n": part(r"(?:^|/)ngram_(\d+)_(\d+)(?:/|$)", 2), "feature_count": part(r"(?:^|/)n(\d+)(?:/|$)", 1)}


def _first_rows(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).csv(root)


def metric_files(spark: SparkSession, root: str) -> DataFrame:
    """path and the first row (strings) of every svm_metrics.csv below root, at any depth."""
    rows = _first_rows(spark, root, "svm_metrics.csv")
    found = rows.withColumns({"_path": F.col("_metadata.file_path"), "_id": F.monotonically_increasing_id()})
    first = found.groupBy("_path").agg(F.min_by(F.struct(*rows.columns), "_id").alias("r"))
    return first.select(F.col("_path").alias("path"), "r.*")


def fold_feature_counts(spark: SparkSession, root: str) -> DataFrame:
    """folder and the mean model_feature_count of its svm_folds.csv; blank counts don't count."""
    rows = _first_rows(spark, root, "svm_folds.csv").select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("folder"), F.col("model_feature_count").try_cast("double").alias("n"))
    return rows.filter("n IS NOT NULL").groupBy("folder").agg(F.avg("n").alias("model_feature_count"))


def fingerprint(paths_sizes_times: DataFrame, version: int) -> str:
    """Of a listing (name, size, mtime) and the version of the preprocessing: its rows' hashes added up,
    so no task holds the listing."""
    row = F.conv(F.substring(F.sha2(F.concat_ws("|", "name", "size", "mtime"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    total = paths_sizes_times.agg(F.sum(row).alias("x"), F.count(F.lit(1)).alias("n"))
    return total.select(F.sha2(F.concat_ws("|", F.lit(str(version)), "n", F.coalesce(F.col("x").cast("string"), F.lit(""))).cast("binary"), 256)).first()[0]


def cached_texts(spark: SparkSession, folder: str, cache: str, version: int) -> DataFrame:
    """text_folder(folder) from a cache that is fresh while no file's name, size or time changes, nor the version."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[tT][xX][tT]").load(folder)
    listing = files.select(F.col("path").alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    return cached(spark, cache, fingerprint(listing, version), lambda: text_folder(spark, folder))


def cached(spark: SparkSession, folder: str, key: str, build) -> DataFrame:
    """The Parquet table folder/key, built and written once; another key is another table.

    It is written beside its place and renamed once whole, so a write that was killed half-way is never read. Of two that
    build at once one is kept; both would hold the same rows.
    """
    path = f"{folder.rstrip('/')}/{key}"
    at, beside = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{folder.rstrip('/')}/_writing-{uuid.uuid4().hex}"))
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        try:
            build().write.parquet(beside.toString())
            if not files.exists(at) and not files.rename(beside, at) and not files.exists(at):
                raise OSError(f"{path} can't be published")
        finally:
            files.delete(beside, True)
    return spark.read.parquet(path)


def content_key(settings: dict, rows: DataFrame) -> str:
    """SHA-256 of settings (in any order) and of the rows whatever their order and partitions: their hashes' sums and number."""
    names = sorted(rows.columns)
    sums = rows.agg(*[F.sum(F.xxhash64(F.lit(salt), *[F.col(f"`{c}`") for c in names]).cast("decimal(38,0)")).alias(f"s{salt}") for salt in (1, 2)], F.count(F.lit(1)).alias("n")).first()
    said = json.dumps({"settings": settings, "columns": [(c, rows.schema[c].dataType.simpleString()) for c in names], "rows": [str(v) for v in sums]}, sort_keys=True)
    return hashlib.sha256(said.encode()).hexdigest()
