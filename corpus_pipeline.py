"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the
columns of documents (the last adds shard). Empty tables give empty results at every stage; extra
columns stay, whatever their names (a column named shard is replaced by the last stage).

| case | quality | near duplicates | decontamination | mixing | sharding |
|-|-|-|-|-|-|
| null or empty text | goes (no words) | stays, a class of its own | stays, clean | stays once | stays |
| null doc_id | judged by its text | stays unless another row of its class has an id | by its text | all share one draw | the empty key's shard |
| repeated rows | each alike | one stays | each alike | each the same copies | the same shard |
| ties | - | the least text hash of the least doc_id | - | - | - |
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termforge.llm import decontaminate, mixing, near_dup, quality_rules, sharding
from termforge.llm._store import documents, drop, keep, made, sweep


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return near_dup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans that occur in the benchmark are cut out; documents that are mostly such spans go."""
    return decontaminate.decontaminate(docs, documents(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out by rates that bring domain token shares to their targets."""
    return mixing.mix(docs, mixing.domains(documents(spark, sf_dir, "labels")))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document gets its shard."""
    return sharding.assign(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("sharding", shards),
]

#: Signatures, automata and fitted rates have no SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        before, tables = docs, made()
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = keep(docs)
            sweep(spark, tables, docs)
            drop(spark, before)
    return docs
