"""Shard placement by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table, a permutation given by
an offset and a step that its name determines. Shards take turns claiming the next free slot they
prefer, so all own nearly the same number of slots and a change of the shard set moves few of
them. A key's hash names its slot: one look-up in a table of fixed size, which is broadcast (its
size depends on no data). Nulls are keys like any other; repeated rows go to the same shard; no
row is dropped; columns of the input stay, `shard` is added (a clashing one is replaced).
"""

from __future__ import annotations

import hashlib
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime of some hundred slots a shard.
SLOTS = 65_537
SHARDS = 64


def table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Of each slot the index of its shard. slots must be prime and no fewer than the shards."""
    if not shards or len(shards) > slots or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct, at least one, and no more than slots")
    if slots < 2 or any(slots % k == 0 for k in range(2, math.isqrt(slots) + 1)):
        raise ValueError(f"slots must be prime, or a shard's steps don't reach every slot: {slots}")
    digests = [hashlib.md5(s.encode()).digest() for s in shards]
    place = [int.from_bytes(d[:8], "big") % slots for d in digests]
    step = [1 + int.from_bytes(d[8:], "big") % (slots - 1) for d in digests]
    owner, free = [-1] * slots, slots
    while free:
        for k in range(len(shards)):
            while owner[place[k]] >= 0:
                place[k] = (place[k] + step[k]) % slots
            owner[place[k]] = k
            free -= 1
            if not free:
                break
    return owner


def slot(key: Column, slots: int = SLOTS) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % F.lit(slots)


def assign(docs: DataFrame, key: str = "doc_id", shards: list[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """docs and the int column shard; a map-side join with the broadcast table, no shuffle."""
    names = shards or [f"shard-{k:05d}" for k in range(SHARDS)]
    owner = table(names, slots)
    spark = docs.sparkSession
    lookup = spark.createDataFrame(pd.DataFrame({"_tf_slot": range(slots), "_tf_shard": owner}), "_tf_slot long, _tf_shard int")
    others = [c for c in docs.columns if c != "shard"]
    placed = docs.select(*[F.col(f"`{c}`") for c in others], slot(F.col(f"`{key}`"), slots).alias("_tf_slot"))
    return placed.join(F.broadcast(lookup), "_tf_slot").select(*[F.col(f"`{c}`") for c in others], F.col("_tf_shard").alias("shard"))
