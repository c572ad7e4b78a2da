"""The labelled corpus of a scale folder and what most queries start from."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from termforge.operators import contrast, corpus, extensions, matrix, select
from termforge.session import ship
from termforge.operators.tables import kept


class Base:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        ship(spark)
        self.spark, self.dir = spark, sf_dir
        self.tokenizer, self.cache = extensions.TOKENIZERS[extensions.current("tokenizer")], extensions.current("cache")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def corpus(self) -> DataFrame:
        return corpus.labelled_corpus(self.table("documents"), self.table("labels"))

    @cached_property
    def raw_corpus(self) -> DataFrame:
        return corpus.labelled_corpus(self.table("documents"), self.table("labels"), normalise=False)

    def toks(self, low: int = 1, high: int = 1) -> DataFrame:
        return corpus.tokens(self.corpus, low, high, tokenizer=self.tokenizer)

    @cached_property
    def post(self) -> DataFrame:
        """Cached: nearly every query reads the postings more than once, and all of one folder share them until tables.release()."""
        return kept(corpus.postings(self.toks()))

    @cached_property
    def lens(self) -> DataFrame:
        return corpus.lengths(self.toks())

    @cached_property
    def sizes(self) -> DataFrame:
        """From the labels alone: texts aren't read for it."""
        own = self.table("labels").select("doc_id", "quality").join(self.table("documents").select("doc_id"), "doc_id")
        return corpus.class_sizes(own.selectExpr("quality AS label").filter("label IS NOT NULL"))

    @cached_property
    def scores(self) -> DataFrame:
        return contrast.score_table(self.post, self.sizes)

    @cached_property
    def idf(self) -> DataFrame:
        return matrix.idf(self.post, self.sizes)

    @cached_property
    def weights(self) -> DataFrame:
        return matrix.tfidf(self.post, self.idf)

    def top(self, k: int) -> DataFrame:
        return select.top(self.scores, select.SCORE_ORDER, k)
