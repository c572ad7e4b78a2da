"""Intermediate tables of the library: written to the shared folder or cached, known, and released together.

written() is for rows that must be the same at every reading, whatever executors are lost meanwhile: an order dealt to
ranges, a state that a loop goes on from. kept() is for rows that are merely read more than once. What either made stands
until release(), which a long session calls when it has read the results that it wants.
"""

from __future__ import annotations

import atexit
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

from termforge.session import shared_folder

_WRITTEN: dict[str, SparkSession] = {}
_KEPT: list[DataFrame] = []


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet under the shared folder and read back; cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/termforge-tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._termforge_table = path
    _WRITTEN[path] = spark
    return out


def kept(df: DataFrame) -> DataFrame:
    """df, cached once something reads it."""
    _KEPT.append(df.persist())
    return df


def drop(df: DataFrame) -> None:
    """Deletes a written table that nothing reads any more."""
    _delete(getattr(df, "_termforge_table", None))


def _delete(path: str | None) -> None:
    spark = _WRITTEN.pop(path, None)
    if spark is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release() -> None:
    """Lets go of all tables and caches; results that still read them must have been read before."""
    for df in _KEPT:
        df.unpersist()
    _KEPT.clear()
    for path in list(_WRITTEN):
        _delete(path)


@atexit.register
def _at_end() -> None:
    try:
        for path, spark in list(_WRITTEN.items()):
            if spark.sparkContext._jsc is not None:
                _delete(path)
    except (Py4JError, OSError):  # the JVM has gone first
        pass
