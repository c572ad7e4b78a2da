"""Document counts kept up to date over a stream of labelled documents; counts are additive, so updates are exact."""

from __future__ import annotations

from pyspark.sql import DataFrame

from termforge.operators import corpus, matrix


def running_document_frequency(documents: DataFrame) -> DataFrame:
    """term, df, df1, df0 over a stream of doc_id, label, text (each document once); for output mode update or complete."""
    from pyspark.sql import functions as F

    toks = corpus.tokens(documents)
    terms = toks.select("doc_id", "label", F.explode(F.array_distinct("toks")).alias("term"))
    return matrix.document_frequency(terms)
