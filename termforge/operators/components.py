"""Principal components of sparse term matrices by randomised subspace iteration on postings.

The matrix is rows doc_id, term, value; absent postings are zeros. It is never made dense, nor centred: a product with the
centred matrix is the sparse product less the column means' share, a vector of as many numbers as there are components.
A pass multiplies by the matrix (postings meet the terms' vectors, sums by document) and by its transpose (postings meet the
documents' vectors, sums by term); blocks are made orthonormal by their Gram matrix, a number a pair of components,
which is all that the driver sees. Terms' and documents' vectors stay distributed, written once a pass.

The first block is drawn from hashes of the terms, so a result doesn't depend on how rows are dealt. A document without
postings has the scores of the mean's negative; repeated postings of a document and term add up; an empty table has no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termforge.operators import select
from termforge.operators.corpus import r9
from termforge.operators.tables import drop, written


def _sum(vector: str, by: str, rows: DataFrame, width: int) -> DataFrame:
    """by, vec: element-wise sums of rows' vectors; one partial aggregate."""
    found = rows.groupBy(by).agg(*[F.sum(F.get(vector, F.lit(k))).alias(f"s{k}") for k in range(width)])
    return found.select(by, F.array(*[F.col(f"s{k}") for k in range(width)]).alias("vec"))


def _gram(rows: DataFrame, width: int) -> np.ndarray:
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    got = rows.agg(*[F.sum(F.get("vec", F.lit(i)) * F.get("vec", F.lit(j))).alias(f"g{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((width, width))
    for i, j in pairs:
        out[i, j] = out[j, i] = got[f"g{i}_{j}"] or 0.0
    return out


def _times(vector: Column, matrix: np.ndarray) -> Column:
    """A row vector times a small matrix."""
    return F.array(*[sum((F.get(vector, F.lit(i)) * F.lit(float(matrix[i, j])) for i in range(len(matrix))), F.lit(0.0)) for j in range(matrix.shape[1])])


def _orthonormal(rows: DataFrame, by: str, width: int) -> DataFrame:
    """The same span with orthonormal columns; columns that depend on others become 0."""
    values, axes = np.linalg.eigh(_gram(rows, width))
    good = values > 1e-14 * max(values.max(), 1e-300)
    turn = axes * np.where(good, 1 / np.sqrt(np.where(good, values, 1.0)), 0.0)
    return written(rows.select(by, _times(F.col("vec"), turn).alias("vec")))


def principal(posted: DataFrame, docs: DataFrame, k: int, passes: int = 40, spare: int = 10, tolerance: float = 1e-13) -> tuple[DataFrame, DataFrame, list[float]]:
    """(scores: doc_id, s; loadings: term, loading; explained shares) of the k first components of the centred matrix.

    posted: doc_id, term, value; docs: doc_id of all rows. Ends when no share moves by more than `tolerance`, at `passes` at
    the latest. Of each component the loading of the largest size (ties: the first term) is positive.
    """
    n = docs.count()
    own = written(posted.groupBy("doc_id", "term").agg(F.sum("value").alias("value")))
    terms = own.groupBy("term").agg((F.sum("value") / F.lit(float(max(n, 1)))).alias("mean"), F.sum(F.col("value") * F.col("value")).alias("square"))
    means = written(terms)
    known = means.agg(F.count(F.lit(1)).alias("d"), F.sum("square").alias("all"), F.sum(F.col("mean") * F.col("mean")).alias("centre")).first()
    total = (known["all"] or 0.0) - n * (known["centre"] or 0.0)
    width = min(k + spare, known["d"], n)
    k = min(k, width)
    if not k:
        return docs.select("doc_id", F.array().cast("array<double>").alias("s")).limit(0), means.select("term", F.array().cast("array<double>").alias("loading")).limit(0), []
    uniform = lambda j: (F.pmod(F.xxhash64("term", F.lit(j)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    normal = lambda j: F.sqrt(-2 * F.log(uniform(2 * j))) * F.cos(2 * np.pi * uniform(2 * j + 1))
    block = _orthonormal(means.select("term", F.array(*[normal(j) for j in range(width)]).alias("vec")), "term", width)

    def centre(block: DataFrame) -> np.ndarray:
        """The column means times the block."""
        got = means.join(block, "term").agg(*[F.sum(F.col("mean") * F.get("vec", F.lit(j))).alias(f"c{j}") for j in range(width)]).first()
        return np.array([got[f"c{j}"] or 0.0 for j in range(width)])

    def scores(block: DataFrame) -> DataFrame:
        """doc_id, vec: the centred matrix times the block; every document has a row."""
        off = centre(block)
        weighted = own.join(block, "term").select("doc_id", F.transform("vec", lambda x: x * F.col("value")).alias("vec"))
        sums = docs.select("doc_id").join(_sum("vec", "doc_id", weighted, width), "doc_id", "left")
        return written(sums.select("doc_id", F.array(*[F.coalesce(F.get("vec", F.lit(j)), F.lit(0.0)) - float(off[j]) for j in range(width)]).alias("vec")))

    before = np.zeros(width)
    for turn in range(1, passes + 1):
        table = scores(block)
        values, axes = np.linalg.eigh(_gram(table, width))
        values, axes = values[::-1], axes[:, ::-1]
        if turn == passes or np.abs(values - before)[:k].max() <= tolerance * max(total, 1e-300):
            break
        before = values
        # a centred block's columns sum to 0, so the transposed product needs no centring
        back = own.join(table, "doc_id").select("term", F.transform("vec", lambda x: x * F.col("value")).alias("vec"))
        following = _orthonormal(_sum("vec", "term", back, width), "term", width)
        drop(block)
        drop(table)
        block = following
    turned = block.select("term", _times(F.col("vec"), axes[:, :k]).alias("loading"))
    size = lambda j: F.get("loading", F.lit(j))
    first = turned.agg(*[F.min(F.struct(-F.round(F.abs(size(j)), 9), "term", size(j).alias("l"))).alias(f"l{j}") for j in range(k)]).first()
    signed = axes[:, :k] * np.array([1.0 if first[f"l{j}"]["l"] >= 0 else -1.0 for j in range(k)])
    shares = [float(v / total) if total > 0 else 0.0 for v in values[:k]]
    return table.select("doc_id", _times(F.col("vec"), signed).alias("s")), block.select("term", _times(F.col("vec"), signed).alias("loading")), shares


def report(scores: DataFrame, loadings: DataFrame, shares: list[float], labels: DataFrame, top: int = 5) -> DataFrame:
    """A row a component: explained and cumulative share, the scores' correlation with the label, what that says
    (label1_axis, label0_axis or irrelevant below 0.2), mean scores by label, and its `top` highest and lowest terms."""
    k = len(shares)
    own = scores.join(labels.select("doc_id", "label"), "doc_id").select("label", F.posexplode("s").alias("component", "v"))
    mean = lambda y: F.avg(F.when(F.col("label") == y, F.col("v")))
    about = own.groupBy("component").agg(F.coalesce(F.corr("v", F.col("label").cast("double")), F.lit(0.0)).alias("r"), mean(1).alias("label1_mean"), mean(0).alias("label0_mean"))
    each = loadings.select("term", F.posexplode("loading").alias("component", "l"))

    def ends(sign: int, name: str) -> DataFrame:
        best = select.top(each.withColumn("by", sign * F.round("l", 9)), ["by DESC", "term"], top, "nth", ["component"])
        said = F.concat("term", F.lit(":"), F.format_string("%.6f", "l"))
        return best.groupBy("component").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", said.alias("t")))), lambda x: x["t"]), ", ").alias(name))

    explained = F.get(F.array(*map(F.lit, shares)), F.col("component"))
    upto = F.get(F.array(*[F.lit(float(sum(shares[: i + 1]))) for i in range(k)]), F.col("component"))
    axis = F.when(F.abs("r") < 0.2, "irrelevant").when(F.col("r") > 0, "label1_axis").otherwise("label0_axis")
    rows = about.join(ends(1, "top_terms"), "component").join(ends(-1, "bottom_terms"), "component")
    return rows.select("component", r9(explained).alias("explained"), r9(upto).alias("cumulative"), r9("r").alias("label_correlation"), axis.alias("reads_as"), r9("label1_mean").alias("label1_mean"), r9("label0_mean").alias("label0_mean"), "top_terms", "bottom_terms")
