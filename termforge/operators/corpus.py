"""The labelled corpus: doc_id, label 0/1, text; its tokens, postings and lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termforge.functions import text as T


def labelled_corpus(docs: DataFrame, labels: DataFrame, label: str = "quality", normalise: bool = True) -> DataFrame:
    """doc_id, label, doc_name, text of the documents that have a label."""
    own = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("label").isNotNull())
    body = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.concat_ws("-", "source", "doc_id").alias("doc_name"), (T.normalize_text(body) if normalise else body).alias("text")).join(own, "doc_id")


def union_corpora(positive: DataFrame, negative: DataFrame) -> DataFrame:
    """Two class folders as one corpus: label 1, then 0."""
    return positive.withColumn("label", F.lit(1)).unionByName(negative.withColumn("label", F.lit(0)), allowMissingColumns=True)


def map_labels(rows: DataFrame, label: str, mapping: dict[str, int]) -> DataFrame:
    """Drops rows without label; trims and lower-cases; an unknown label is an error."""
    key = F.lower(F.trim(F.col(label)))
    out = F.lit(None).cast("int")
    for k, v in mapping.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return rows.filter(F.col(label).isNotNull()).withColumn("label", F.when(out.isNull(), F.raise_error(F.concat(F.lit("unknown label: "), key)).cast("int")).otherwise(out))


def tokens(corpus: DataFrame, low: int = 1, high: int = 1, min_len: int = 2, stop_words: list[str] | None = None, tokenizer=None) -> DataFrame:
    """doc_id, label, toks: n-grams of the tokens left after stop words."""
    toks = (tokenizer or T.tokenize)(F.col("text"), min_len)
    toks = T.remove_stop_words(toks, T.STOP_WORDS if stop_words is None else stop_words)
    unigrams = corpus.select("doc_id", "label", toks.alias("toks"))
    return unigrams if (low, high) == (1, 1) else unigrams.withColumn("toks", T.ngrams(F.col("toks"), low, high))


def exploded(rows: DataFrame, array: str, name: str, *others: str) -> DataFrame:
    """others and a row an element of the array, as F.explode gives them. That one lets Spark ask for the array's size first, where
    the texts are read, so that they would be cut into tokens twice, those without a label too."""
    return rows.select(*others, F.posexplode_outer(array).alias("_nth", name)).filter("_nth IS NOT NULL").drop("_nth")


def postings(toks: DataFrame) -> DataFrame:
    """doc_id, label, term, tf; partial counts before the shuffle."""
    return exploded(toks, "toks", "term", "doc_id", "label").groupBy("doc_id", "label", "term").agg(F.count(F.lit(1)).alias("tf"))


def stemmed(posted: DataFrame) -> DataFrame:
    """Postings over stems; only distinct words go through the stemmer."""
    stems = posted.select("term").distinct().withColumn("stem", T.stem(F.col("term")))
    return posted.join(stems, "term").groupBy("doc_id", "label", F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))


def lengths(toks: DataFrame) -> DataFrame:
    return toks.select("doc_id", "label", F.size("toks").cast("long").alias("len_tokens"))


def class_sizes(corpus: DataFrame) -> DataFrame:
    """One row: n1, n0, n. Small by construction, so joins with it broadcast."""
    return corpus.agg(F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label") == 0).alias("n0"), F.count(F.lit(1)).alias("n"))


def r9(x: Column) -> Column:
    """Nine decimals and no negative zero, so sums in another order compare equal."""
    return F.round(x, 9) + F.lit(0.0)


def by_position(first: DataFrame, first_order: list[Column], second: DataFrame, second_order: list[Column]) -> DataFrame:
    """The rows of two listings side by side, the n-th of one with the n-th of the other, each in its own order.

    Both are numbered by ranges and meet by their places. Listings of different length are an error, as rows would belong to
    other ones than they stand beside. Columns that both have must not clash.
    """
    from termforge.operators import ranges

    sizes = [df.count() for df in (first, second)]
    if sizes[0] != sizes[1]:
        raise ValueError(f"the listings differ in length: {sizes[0]} and {sizes[1]} rows")
    a, b = ranges.numbered(first, first_order, "_place"), ranges.numbered(second, second_order, "_place")
    return a.join(b, "_place").drop("_place")
