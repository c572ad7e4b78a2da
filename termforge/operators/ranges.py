"""Global numbering and running sums by ranges: no task sees all rows.

Rows are dealt to ranges of the order; a range's totals (one row a range) give what lies before it.
The dealt rows are written to the shared folder: both the rows and the totals must see the same ranges, and
a range that was dealt anew after the loss of an executor could hold other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termforge.operators.tables import written

#: monotonically_increasing_id() holds the partition above so many bits, the row below.
ROW_BITS = 33


def _parts(rows: DataFrame) -> int:
    return max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def numbered(rows: DataFrame, order: list[Column], name: str, start: int = 1) -> DataFrame:
    """rows with their places in a total order, from `start`."""
    at = F.monotonically_increasing_id()
    placed = written(rows.repartitionByRange(_parts(rows), *order).sortWithinPartitions(*order).withColumn("_at", at))
    part = F.shiftright("_at", ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_k"))
    before = sizes.select("_part", (F.sum("_k").over(W.orderBy("_part")) - F.col("_k")).alias("_before"))
    own = F.col("_at") - F.shiftleft("_part", ROW_BITS)
    return placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + own + start).drop("_part", "_at", "_before")


def running(rows: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """rows with running sums over a total order: name of the sum to the column summed, the row's own included."""
    placed = written(rows.repartitionByRange(_parts(rows), *order).withColumn("_part", F.spark_partition_id()))
    totals = placed.groupBy("_part").agg(*[F.sum(c).alias(f"_all_{n}") for n, c in sums.items()])
    before = totals.select("_part", *[(F.sum(f"_all_{n}").over(W.orderBy("_part")) - F.col(f"_all_{n}")).alias(f"_before_{n}") for n in sums])
    own = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = placed.withColumns({n: F.sum(c).over(own) for n, c in sums.items()})
    joined = inside.join(F.broadcast(before), "_part")
    return joined.withColumns({n: F.col(n) + F.col(f"_before_{n}") for n in sums}).drop("_part", *[f"_before_{n}" for n in sums])
