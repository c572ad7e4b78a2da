"""Statistics as aggregates: quartiles, tests, histograms, curves, distances, principal components."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termforge.operators import ranges
from termforge.operators.corpus import r9
from termforge.operators.tables import written


def quantiles(rows: DataFrame, shares: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """(grp, v, c and grp, n and a column a share) of rows grp, v (and c, how often, if they have it): counted values, and
    interpolated quantiles.

    Equal values are counted before the shuffle; counted values are summed up by ranges of (grp, v),
    so a large group is spread over tasks, and a quantile is read off at the two ranks around it.
    """
    own = rows.filter(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    counted = own.groupBy("grp", "v").agg((F.sum("c") if "c" in rows.columns else F.count(F.lit(1))).alias("c"))
    upto = ranges.running(counted, [F.col("grp"), F.col("v")], {"upto": "c"})
    sizes = upto.groupBy("grp").agg(F.sum("c").alias("n"), F.min(F.col("upto") - F.col("c")).alias("start"))
    at = upto.join(sizes, "grp").withColumn("past", F.col("upto") - F.col("start")).withColumn("before", F.col("past") - F.col("c"))

    def value(rank: Column) -> Column:
        return F.max(F.when((F.col("before") <= rank) & (rank < F.col("past")), F.col("v")))

    places = {q: (F.col("n") - 1) * share for q, share in shares.items()}
    found = at.groupBy("grp", "n").agg(*[value(f(p)).alias(f"{q}{side}") for q, p in places.items() for side, f in (("a", F.floor), ("b", F.ceil))])
    between = lambda q: F.col(f"{q}a") + (F.col(f"{q}b") - F.col(f"{q}a")) * (places[q] - F.floor(places[q]))
    return upto.select("grp", "v", "c"), found.select("grp", "n", *[between(q).alias(q) for q in shares])


def quartiles(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return quantiles(rows, {"q1": 0.25, "q3": 0.75})


def iqr(rows: DataFrame, multiplier: float = 1.5) -> DataFrame:
    """rows: grp, v (and c). Tukey statistics of each group's finite values."""
    counted, q = quartiles(rows)
    width = F.col("q3") - F.col("q1")
    out = F.when((F.col("v") < F.col("q1") - multiplier * width) | (F.col("v") > F.col("q3") + multiplier * width), F.col("c")).otherwise(0)
    found = counted.join(q, "grp").groupBy("grp", "n", "q1", "q3").agg(F.sum(out).alias("outliers"), F.max("v").alias("top"))
    return found.select("grp", "n", r9(F.col("q1")).alias("q1"), r9(F.col("q3")).alias("q3"), r9(width).alias("iqr"), "outliers", r9(F.col("outliers") / F.col("n")).alias("outlier_rate"), r9(F.col("top")).alias("max_value"))


def welch(rows: DataFrame) -> DataFrame:
    on = lambda k: F.when(F.col("label") == k, F.col("v"))
    m = rows.agg(*[f(on(k)).alias(f"{n}{k}") for k in (1, 0) for n, f in (("m", F.avg), ("v", F.var_samp), ("k", F.count))])
    a, b = F.col("v1") / F.col("k1"), F.col("v0") / F.col("k0")
    return m.select(r9((F.col("m1") - F.col("m0")) / F.sqrt(a + b)).alias("t"), r9((a + b) * (a + b) / (a * a / (F.col("k1") - 1) + b * b / (F.col("k0") - 1))).alias("freedom"))


def _tied_ranks(rows: DataFrame, value: str) -> DataFrame:
    """(value, p, n, before): counts by distinct value and rows below it; distinct values are summed up by ranges."""
    at = rows.groupBy(value).agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")).withColumn("here", F.col("p") + F.col("n"))
    return ranges.running(at, [F.col(value)], {"upto": "here"}).select(value, "p", "n", (F.col("upto") - F.col("here")).alias("before"))


def mann_whitney(rows: DataFrame) -> DataFrame:
    rank = F.col("before") + (F.col("p") + F.col("n") + 1) / 2.0
    return _tied_ranks(rows, "v").agg(F.sum(F.col("p") * rank).alias("r"), F.sum("p").alias("k")).select(r9(F.col("r") - F.col("k") * (F.col("k") + 1) / 2.0).alias("u"))


def auc(rows: DataFrame) -> DataFrame:
    rank = F.col("before") + (F.col("p") + F.col("n") + 1) / 2.0
    sums = _tied_ranks(rows, "decision").agg(F.sum(F.col("p") * rank).alias("r"), F.sum("p").alias("k1"), F.sum("n").alias("k0"))
    return sums.select(r9((F.col("r") - F.col("k1") * (F.col("k1") + 1) / 2.0) / (F.col("k1") * F.col("k0"))).alias("auc"))


def roc(rows: DataFrame) -> DataFrame:
    """decision, tp, fp: rows at or above each distinct decision, by label."""
    at = rows.groupBy("decision").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    return ranges.running(at, [F.col("decision").desc()], {"tp": "p", "fp": "n"}).select("decision", "tp", "fp")


def precision_recall(rows: DataFrame) -> DataFrame:
    """decision, precision, recall of predicting 1 at or above each distinct decision."""
    positives = rows.agg(F.sum("label").alias("positives"))
    points = roc(rows).crossJoin(F.broadcast(positives))
    return points.select("decision", r9(F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), r9(F.when(F.col("positives") > 0, F.col("tp") / F.col("positives")).otherwise(F.lit(0.0))).alias("recall"))


def permutation(rows: DataFrame, resamples: int, seed: int = 0, block: int = 500) -> DataFrame:
    """(extreme + 1) / (resamples + 1) for the difference of means; blocks of resamples are spread over tasks.

    Each block draws from its own generator, seeded by its number, so the result depends on the
    resamples, the seed and the block size alone. Label-1 sets are drawn from a histogram of all
    values (counts by value), whose size doesn't grow with repeated values.
    """
    counts = rows.groupBy("v").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("label") == 1).alias("c1")).orderBy("v").toPandas()
    n, n1 = int(counts.c.sum()), int(counts.c1.sum())
    v, c = counts.v.to_numpy(float), counts.c.to_numpy()
    total = float((v * c).sum())
    mine = float((v * counts.c1).sum())
    seen = mine / n1 - (total - mine) / (n - n1)

    way = "count" if n < 20 * len(v) and n <= 1_000_000 else "marginals"  # drawing rows, or one number a distinct value

    def extremes(number: int) -> int:
        own = np.random.default_rng([seed, number])
        s = own.multivariate_hypergeometric(c, n1, size=min(block, resamples - number * block), method=way) @ v
        return int((np.abs(s / n1 - (total - s) / (n - n1)) >= abs(seen) - 1e-12).sum())

    def run(numbers: pd.Series) -> pd.Series:
        return numbers.map(extremes)

    blocks = -(-resamples // block)
    spark = rows.sparkSession
    hits = spark.range(0, blocks, 1, min(blocks, 64)).select(F.pandas_udf(run, "long")("id").alias("extreme"))
    return hits.agg(((F.sum("extreme") + 1) / F.lit(resamples + 1)).alias("p")).withColumn("difference", F.lit(seen))


def histogram(rows: DataFrame, bins: int) -> DataFrame:
    edges = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) * float(bins) / (F.col("hi") - F.col("lo"))).cast("int"))
    return rows.crossJoin(F.broadcast(edges)).groupBy("label", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def nearest(vectors: DataFrame, queries: str | DataFrame, k: int, gamma: float, block: int = 16_384) -> DataFrame:
    """The k nearest rows of each stated query row by Euclidean distance, and the RBF feature-space distance.

    queries: a condition, or rows qid, e. They meet all rows in blocks: each partition of vectors meets one block of at
    most about `block` query rows at a time, keeps its best of each (see _closest), and only those are shuffled. With several
    blocks each one's result is written before the next begins. Where vectors differ in length or hold nulls or NaN, every
    distance is an expression of Spark's instead.
    """
    q = vectors.filter(queries).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("e")) if isinstance(queries, str) else queries
    odd = lambda e: F.coalesce(F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) > 1e15)), F.lit(True))
    shape = lambda df, e: df.agg(F.count(F.lit(1)).alias("n"), F.min(F.size(e)).alias("low"), F.max(F.size(e)).alias("high"), F.bool_or(odd(e)).alias("odd")).first()
    mine, all_rows = shape(q, "e"), shape(vectors, "embedding")
    plain = mine["n"] and all_rows["n"] and not (mine["odd"] or all_rows["odd"]) and len({mine["low"], mine["high"], all_rows["low"], all_rows["high"]}) == 1 and mine["low"] > 0
    blocks = max(1, -(-mine["n"] // block))
    square = F.aggregate(F.zip_with("e", "embedding", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda a, b: a + b)
    best = None
    for n in range(blocks):
        own = q.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == n) if blocks > 1 else q
        if plain:
            d = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInPandas(_closest(own, k), "qid long, vec_id long, square double")
            d = d.select("qid", "vec_id", F.round(F.sqrt("square"), 6).alias("dist"))
        else:
            d = vectors.select("vec_id", "embedding").crossJoin(F.broadcast(own)).filter("vec_id <> qid").select("qid", "vec_id", F.round(F.sqrt(square), 6).alias("dist"))
        d = d.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("dist", "vec_id"))).filter(F.col("rank") <= k)
        d = written(d) if blocks > 1 else d
        best = d if best is None else best.unionByName(d)
    return best.select("qid", "vec_id", "dist", (F.round(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.exp(-gamma * F.col("dist") * F.col("dist")))), 6) + 0.0).alias("rbf_dist"), "rank")


#: Rows that meet a block of queries in one matrix product, and pairs whose exact squares are held at once.
TILE, PAIRS = 512, 1 << 18


def _closest(queries: DataFrame, k: int):
    """For mapInPandas: of each query (a block of fixed size) the rows of a partition that can be among its k nearest.

    A matrix product in single precision says which rows can't be, by a bound of its error; the others' squares are summed in
    double precision in the order of the dimensions. Kept are rows up to the k-th distance and 2e-6 more, as distances are
    rounded to six decimals before they are compared; of rows of one square the k smallest ids.
    """
    own = queries.select("qid", F.col("e").cast("array<double>").alias("e")).toPandas()
    held = queries.sparkSession.sparkContext.broadcast((own.qid.to_numpy(), np.stack(own.e.to_list()) if len(own) else np.zeros((0, 1))))

    def run(batches):
        qids, q = held.value
        dims, norm = q.shape[1], (q * q).sum(1)
        wide = np.hstack([q, np.ones((len(q), 1))]).astype(np.float32)
        limit = np.full(len(q), np.inf)  # squares above it are out
        kept = (np.zeros(0, int), np.zeros(0), np.zeros(0, int))  # query, square, vec_id

        def best(*parts):
            i, square, ids = (np.concatenate(p) for p in zip(*parts, strict=True))
            order = np.lexsort((ids, square, i))
            i, square, ids = i[order], square[order], ids[order]
            new = np.ones(len(i), bool)
            new[1:] = (i[1:] != i[:-1]) | (square[1:] != square[:-1])
            first = np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))
            few = np.arange(len(i)) - first < k
            i, square, ids = i[few], square[few], ids[few]
            begin, end = np.searchsorted(i, np.arange(len(q))), np.searchsorted(i, np.arange(len(q)), "right")
            full = end - begin >= k
            limit[full] = (np.sqrt(square[begin[full] + k - 1]) + 2e-6) ** 2
            near = square <= limit[i]
            return i[near], square[near], ids[near]

        for batch in batches if len(q) else ():
            every = np.stack(batch.embedding.to_list())
            names = batch.vec_id.to_numpy()
            for start in range(0, len(every), TILE):
                e, ids = every[start : start + TILE], names[start : start + TILE]
                size = (e * e).sum(1)
                g = wide @ np.hstack([-2 * e, size[:, None]]).astype(np.float32).T  # the square less the query's norm
                room = (dims + 8) * 2.5e-7 * (norm + 2 * size.max()) + 1e-30
                cut = limit - norm
                if not np.isfinite(limit).all() and len(e) > k:  # one of the k + 1 nearest may be the query itself
                    kth = np.partition(g, k, axis=1)[:, k] + room
                    cut = np.minimum(cut, (np.sqrt(np.maximum(kth + norm, 0)) + 2e-6) ** 2 - norm)
                at = np.flatnonzero(g <= np.where(np.isfinite(cut), cut + room, np.finfo(np.float32).max).astype(np.float32)[:, None])
                i, j = at // len(e), at % len(e)
                other = qids[i] != ids[j]
                i, j = i[other], j[other]
                for p in range(0, len(i), PAIRS):
                    a, b, square = i[p : p + PAIRS], j[p : p + PAIRS], 0.0
                    for x in range(dims):
                        gap = q[a, x] - e[b, x]
                        square = square + gap * gap
                    close = square <= limit[a]
                    kept = best(kept, (a[close], square[close], ids[b[close]]))
        yield pd.DataFrame({"qid": qids[kept[0]] if len(q) else np.zeros(0, int), "vec_id": kept[2], "square": kept[1]})

    return run


def local_outlier_factor(vectors: DataFrame, queries: str, k: int) -> DataFrame:
    """vec_id, density, factor: the local outlier factor of each stated query row among all rows, by k neighbours.

    Density: one over the mean of max(distance, the neighbour's k-th distance), with 1e-10 added; factor: the neighbours'
    mean density over the row's own. Neighbours are searched in rings, each of the rows that the ring before has named
    and none has searched yet: of the queries, of their neighbours (for densities), of those's (for k-th distances).
    """
    done = vectors.filter(queries).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("e"))
    graph = written(nearest(vectors, done, k, 1.0).select("qid", "vec_id", "dist", "rank"))
    rings = [graph]
    for _ in range(2):
        searched = rings[0].select("qid") if len(rings) == 1 else rings[0].select("qid").union(rings[1].select("qid"))
        named = rings[-1].select(F.col("vec_id").alias("qid")).distinct().join(searched.distinct(), "qid", "left_anti")
        rows = vectors.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("e")).join(named, "qid", "left_semi")
        rings.append(written(nearest(vectors, rows, k, 1.0).select("qid", "vec_id", "dist", "rank")))
    every = rings[0].unionByName(rings[1]).unionByName(rings[2])
    reach = every.groupBy("qid").agg(F.max("dist").alias("kth")).withColumnRenamed("qid", "vec_id")
    dense = rings[0].unionByName(rings[1]).join(reach, "vec_id").groupBy("qid").agg((1 / (F.avg(F.greatest("dist", "kth")) + 1e-10)).alias("density"))
    around = rings[0].join(dense.select(F.col("qid").alias("vec_id"), F.col("density").alias("other")), "vec_id").groupBy("qid").agg(F.avg("other").alias("others"))
    return around.join(dense, "qid").select(F.col("qid").alias("vec_id"), F.round("density", 6).alias("density"), F.round(F.col("others") / F.col("density"), 6).alias("factor"))


def nearest_centroid(vectors: DataFrame) -> DataFrame:
    """vec_id, actual, predicted (the label of the nearest class mean), dist; a class mean is one aggregate over its dimensions."""
    e = F.col("embedding").cast("array<double>")
    means = vectors.select("label", F.posexplode(e).alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("v"))
    packed = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("c")).select(F.struct("label", F.transform("c", lambda x: x["v"]).alias("c")).alias("m"))
    classes = packed.agg(F.collect_list("m").alias("means"))  # a vector a class
    far = lambda m: F.round(F.sqrt(F.aggregate(F.zip_with(e, m["c"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)), 6)
    best = F.array_min(F.transform("means", lambda m: F.struct(far(m).alias("dist"), m["label"].alias("label"))))
    return vectors.crossJoin(F.broadcast(classes)).select("vec_id", F.col("label").alias("actual"), best.alias("b")).select("vec_id", "actual", F.col("b.label").alias("predicted"), F.col("b.dist").alias("dist"))


def pca(vectors: DataFrame, k: int) -> DataFrame:
    """One row a component: explained and cumulative share, signed correlation of its scores with the label,
    what that says (label1_axis, label0_axis or irrelevant below 0.2), mean scores by label, and the five
    highest and lowest loadings as 'dimension:loading'. An axis's sign is fixed by its largest loading being positive."""
    scores, axes, shares = pca_fit(vectors, k)
    parts = [F.corr(F.col("s")[i], F.col("label").cast("double")).alias(f"r{i}") for i in range(k)]
    parts += [F.avg(F.when(F.col("label") == y, F.col("s")[i])).alias(f"m{y}_{i}") for i in range(k) for y in (1, 0)]
    wide = scores.agg(*parts)

    def loadings(i: int, highest: bool) -> str:
        order = sorted(range(len(axes)), key=lambda j: (-axes[j][i] if highest else axes[j][i], j))[:5]
        return ", ".join(f"{j}:{axes[j][i]:.6f}" for j in order)

    r = lambda i: F.coalesce(F.col(f"r{i}"), F.lit(0.0))
    rows = F.explode(F.array(*[
        F.struct(F.lit(i).alias("component"), F.lit(shares[i]).alias("explained"), F.lit(float(sum(shares[: i + 1]))).alias("cumulative"), r(i).alias("label_correlation"),
                 F.when(F.abs(r(i)) < 0.2, "irrelevant").when(r(i) > 0, "label1_axis").otherwise("label0_axis").alias("reads_as"),
                 F.col(f"m1_{i}").alias("label1_mean"), F.col(f"m0_{i}").alias("label0_mean"), F.lit(loadings(i, True)).alias("top_loadings"), F.lit(loadings(i, False)).alias("bottom_loadings"))
        for i in range(k)]))
    return wide.select(rows.alias("r")).select("r.*")


def pca_fit(vectors: DataFrame, k: int) -> tuple[DataFrame, list[list[float]], list[float]]:
    """(scores: vec_id, label, s; loadings by dimension and component; explained shares) of centred vectors by Spark ML."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("raw"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="raw", outputCol="x").fit(rows).transform(rows)
    model = PCA(k=k, inputCol="x", outputCol="s").fit(centred)
    axes = model.pc.toArray()
    signs = [1.0 if axes[abs(axes[:, i]).argmax(), i] > 0 else -1.0 for i in range(k)]
    s = F.transform(vector_to_array("s"), lambda v, i: v * F.get(F.array(*map(F.lit, signs)), i))
    return model.transform(centred).select("vec_id", "label", s.alias("s")), (axes * signs).tolist(), model.explainedVariance.toArray().tolist()


def leaf_text(text: str | None) -> str:
    """The non-blank leaf strings of a JSON value, joined by spaces; the text itself where there are none
    or where it isn't JSON (or nested deeper than the parser goes). Null is empty."""
    if text is None:
        return ""
    try:
        left = [json.loads(text)]
    except (ValueError, RecursionError):
        return text
    out = []
    while left:
        value = left.pop()
        if isinstance(value, dict):
            left += reversed(value.values())
        elif isinstance(value, list):
            left += reversed(value)
        elif isinstance(value, str) and value.strip():
            out.append(value)
    return " ".join(out) or text


def json_leaves(rows: DataFrame, column: str) -> DataFrame:
    """rows with column replaced by leaf_text."""

    def leaves(texts: pd.Series) -> pd.Series:
        return texts.map(leaf_text)

    others = [c for c in rows.columns if c != column]
    return rows.select(*others, F.pandas_udf(leaves, "string")(F.col(column)).alias("leaf_text"))
