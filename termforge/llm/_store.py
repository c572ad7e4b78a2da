"""Intermediate tables in the cluster's shared folder: they cut lineage and outlive executors.

An operator drops what it no longer reads; what its lazy result still reads is swept by the pipeline
once the stage's result is written, and the rest at the end of the application.
"""

from __future__ import annotations

import atexit
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

from termforge.session import shared_folder, ship


_MADE: dict[str, SparkSession] = {}


def keep(df: DataFrame) -> DataFrame:
    """Write df as Parquet under spark.checkpoint.dir and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/termforge/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._termforge_path = path
    _MADE[path] = spark
    return out


def drop(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table made by keep() that nothing reads any more."""
    _delete(spark, getattr(df, "_termforge_path", None))


def made() -> set[str]:
    """Paths of the tables that stand now."""
    return set(_MADE)


def sweep(spark: SparkSession, before: set[str], *but: DataFrame) -> None:
    """Delete the tables made since `before` was taken, except those of `but`."""
    held = {getattr(df, "_termforge_path", None) for df in but}
    for path in made() - before - held:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str | None) -> None:
    if path and _MADE.pop(path, None) is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _at_end() -> None:
    try:
        for path, spark in list(_MADE.items()):
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
    except (Py4JError, OSError):  # the JVM has gone first
        pass


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # whole texts: ten times less at once than the default for narrow rows
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
