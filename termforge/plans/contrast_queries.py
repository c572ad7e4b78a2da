"""Label contrasts, rankings and selections (O-70 .. O-124)."""

from __future__ import annotations

from pyspark.sql import functions as F

from termforge.functions import text as T
from termforge.operators import contrast as X
from termforge.operators import corpus as C
from termforge.operators import information
from termforge.operators import matrix as M
from termforge.operators import select as S
from termforge.operators import stats
from termforge.operators.corpus import r9
from termforge.operators.tables import kept
from termforge.plans.base import Base
from termforge.plans.sql import difference, sql
from termforge.plans.sql import r9 as q9

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Base(spark, sf_dir))
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


_EXTRA = {
    "tfv": "SELECT label, term, tf AS value FROM post",
    "dfv": "SELECT label, term, 1 AS value FROM post",
    "rdf": "SELECT post.label, term, 1.0 / len_tokens AS value FROM post JOIN lens USING (doc_id)",
}
_METRICS = [
    ("o70_total_frequency_difference", "tfv", False, lambda b: M.raw(b.post)),
    ("o71_mean_frequency_difference", "tfv", True, lambda b: M.raw(b.post)),
    ("o72_mean_relative_frequency_difference", "rel", True, lambda b: M.relative(b.post, b.lens)),
    ("o73_document_frequency_difference", "dfv", False, lambda b: b.post.withColumn("value", F.lit(1.0))),
    ("o74_mean_document_frequency_difference", "dfv", True, lambda b: b.post.withColumn("value", F.lit(1.0))),
    ("o75_mean_relative_document_frequency_difference", "rdf", True, lambda b: M.relative(b.post.withColumn("tf", F.lit(1)), b.lens)),
    ("o76_tfidf_sum_difference", "weights", False, lambda b: b.weights),
    ("o77_tfidf_average_difference", "weights", True, lambda b: b.weights),
    ("o78_mean_log_normalised_difference", "lognorm", True, lambda b: M.log_normalised(b.post, b.lens)),
    ("o79_mean_tf_l2_difference", "tfl2", True, lambda b: M.l2_rows(M.raw(b.post))),
    ("o80_mean_log_tf_l2_difference", "logl2", True, lambda b: M.l2_rows(M.log_numerator(b.post))),
]
for _name, _source, _mean, _values in _METRICS:
    query(_name, sql(difference(_source, _name[4:], _mean), **_EXTRA))(lambda b, v=_values, m=_mean, n=_name: X.difference_table(v(b), b.sizes if m else None, n[4:]))

query("o81_score_table", sql("SELECT * FROM scores"))(lambda b: b.scores)
query("o95_metric_table", sql(difference("dfv", "doc_rate", True), **_EXTRA))(lambda b: X.difference_table(b.post.withColumn("value", F.lit(1.0)), b.sizes, "doc_rate"))


def _scout_sql(post: str = "post", weights: str = "weights", extra: str = "") -> str:
    one = lambda k: f"{q9(f's{k} / greatest(n{k}, 1)')} AS t{k}, c{k}, d{k}, {q9(f'c{k} / greatest(n{k}, 1)')} AS m{k}, {q9(f'd{k} / greatest(n{k}, 1)')} AS r{k}"
    pairs = []
    for m, a in (("mean_tfidf", "t"), ("total_count", "c"), ("doc_count", "d"), ("mean_count", "m"), ("doc_rate", "r")):
        d = (lambda x: x) if a in "cd" else q9
        pairs.append(f"{a}1 AS label1_{m}, {a}0 AS label0_{m}, {d(f'{a}1 - {a}0')} AS label1_{m}_minus_label0_{m}, {d(f'{a}0 - {a}1')} AS label0_{m}_minus_label1_{m}")
    sums = ", ".join(f"sum(CASE WHEN label = {k} THEN value ELSE 0.0 END) AS s{k}" for k in (1, 0))
    counts = ", ".join(f"CAST(coalesce(sum(tf) FILTER (WHERE label = {k}), 0) AS BIGINT) AS c{k}, count(*) FILTER (WHERE label = {k}) AS d{k}" for k in (1, 0))
    e = f"{extra}, " if extra else ""
    return f"SELECT {e}term, {', '.join(pairs)} FROM (SELECT {e}term, {one(1)}, {one(0)} FROM (SELECT {e}term, {counts} FROM {post} GROUP BY {e}term) JOIN (SELECT {e}term, {sums} FROM {weights} GROUP BY {e}term) USING ({e}term), sizes)"


def _scout(b):
    return X.scout_table(b.post, b.weights, b.sizes)


query("o82_scout_table", sql(_scout_sql()))(_scout)

_NGRAMS = {
    "npost": "SELECT n, doc_id, label, term, count(*) AS tf FROM (SELECT n, doc_id, label, unnest(list_transform(range(1, greatest(len(toks) - n + 2, 1)), lambda i: array_to_string(toks[i : i + n - 1], ' '))) AS term FROM toks, (SELECT unnest(range(1, 6)) AS n)) GROUP BY n, doc_id, label, term",
    "nidf": "SELECT p.n, term, ln((1 + any_value(sizes.n)) / (1 + count(*))) + 1 AS idf FROM npost p, sizes GROUP BY p.n, term",
    "nraw": "SELECT n, doc_id, label, term, tf * idf AS value FROM npost JOIN nidf USING (n, term)",
    "nweights": "SELECT n, doc_id, label, term, value / sqrt(sum(value * value) OVER (PARTITION BY n, doc_id)) AS value FROM nraw",
}


def _size(term="term"):
    """Number of words of an n-gram."""
    return F.size(F.split(term, " ")).cast("long")


def _scout_ngrams(b):
    """The scout table of the n-gram sizes from 1 to 5: the texts are cut once, a term's size is its number of words."""
    post = kept(C.postings(b.toks(1, 5)))
    raw = post.join(M.idf(post, b.sizes), "term").select("doc_id", "label", "term", (F.col("tf") * F.col("idf")).alias("value"), _size().alias("n"))
    return X.scout_table(post, M.l2_rows(raw, ["n", "doc_id"]), b.sizes).withColumn("n", _size())


query("o82_scout_ngrams", sql(_scout_sql("npost", "nweights", "n").replace(", sizes)", ", (SELECT n1, n0 FROM sizes))"), **_NGRAMS))(_scout_ngrams)

_GAP = f"SELECT term, {q9('s1 / n1 - s0 / n0')} AS gap FROM (SELECT term, sum(CASE WHEN label = 1 THEN value ELSE 0.0 END) AS s1, sum(CASE WHEN label = 0 THEN value ELSE 0.0 END) AS s0 FROM weights GROUP BY term), sizes"


@query("o83_tfidf_gap", sql(f"SELECT * FROM (SELECT 'positive' AS side, term, gap, CAST(row_number() OVER (ORDER BY gap DESC, term) AS INTEGER) AS rank FROM (SELECT * FROM gaps WHERE gap > 0)) WHERE rank <= 20 UNION ALL SELECT * FROM (SELECT 'negative' AS side, term, gap, CAST(row_number() OVER (ORDER BY gap, term) AS INTEGER) AS rank FROM (SELECT * FROM gaps WHERE gap < 0)) WHERE rank <= 20", gaps=_GAP))
def _(b):
    gaps = X.difference_table(b.weights, b.sizes, "gap").select("term", F.col("difference").alias("gap"))
    up = S.top(gaps.filter("gap > 0"), ["gap DESC", "term"], 20, "rank").withColumn("side", F.lit("positive"))
    return up.unionByName(S.top(gaps.filter("gap < 0"), ["gap", "term"], 20, "rank").withColumn("side", F.lit("negative")))


_SUMS = "SELECT term, CAST(coalesce(sum(tf) FILTER (WHERE label = 1), 0) AS BIGINT) AS t1, CAST(coalesce(sum(tf) FILTER (WHERE label = 0), 0) AS BIGINT) AS t0, count(*) FILTER (WHERE label = 1) AS d1, count(*) FILTER (WHERE label = 0) AS d0 FROM post GROUP BY term"
_WAYS = {"term_sum_1": "t1 - t0", "term_sum_0": "t0 - t1", "doc_freq_1": "d1 - d0", "doc_freq_0": "d0 - d1"}


@query("o84_class_sums", sql(" UNION ALL ".join(f"SELECT * FROM (SELECT '{w}' AS way, term, {e} AS diff, CAST(row_number() OVER (ORDER BY {e} DESC, term) AS INTEGER) AS rank FROM sums) WHERE rank <= 100" for w, e in _WAYS.items()), sums=_SUMS))
def _(b):
    on = lambda k: F.col("label") == k
    sums = b.post.groupBy("term").agg(*[F.sum(F.when(on(k), F.col("tf")).otherwise(0)).alias(f"t{k}") for k in (1, 0)], *[F.count_if(on(k)).alias(f"d{k}") for k in (1, 0)])
    out = None
    for way, e in _WAYS.items():
        own = S.top(sums.select("term", F.expr(e).alias("diff")), ["diff DESC", "term"], 100, "rank").withColumn("way", F.lit(way))
        out = own if out is None else out.unionByName(own)
    return out


@query("o85_metric_union", sql("SELECT metric_id, count(*) AS terms, " + q9("sum(absolute_difference)") + f" AS total FROM (({difference('tfv', 'tf', False)}) UNION ALL ({difference('dfv', 'df', True)})) GROUP BY metric_id", **_EXTRA))
def _(b):
    both = X.difference_table(M.raw(b.post), None, "tf").unionByName(X.difference_table(b.post.withColumn("value", F.lit(1.0)), b.sizes, "df"))
    return both.groupBy("metric_id").agg(F.count(F.lit(1)).alias("terms"), r9(F.sum("absolute_difference")).alias("total"))


_TARGETS = ["ing", "was", "tion", "thor", "nowhere"]
_TSQL = "(VALUES " + ", ".join(f"('{t}')" for t in _TARGETS) + ") t(term)"
_TGRID = {"tgrid": f"SELECT c.doc_id, c.label, t.term, coalesce(p.tf, 0) AS tf FROM corpus c CROSS JOIN {_TSQL} LEFT JOIN post p ON p.doc_id = c.doc_id AND p.term = t.term"}


def _target_grid(b):
    terms = b.spark.createDataFrame([(t,) for t in _TARGETS], "term string")
    return M.dense(b.post.withColumnRenamed("tf", "value"), b.corpus, terms).withColumn("value", F.col("value").cast("long"))


@query("o86_target_statistics", sql(f"SELECT term, {q9('avg(tf) FILTER (WHERE label = 0)')} AS mean0, {q9('avg(tf) FILTER (WHERE label = 1)')} AS mean1, count(*) FILTER (WHERE label = 0 AND tf > 0) AS docs0, count(*) FILTER (WHERE label = 1 AND tf > 0) AS docs1, {q9('avg(tf) FILTER (WHERE label = 0) - avg(tf) FILTER (WHERE label = 1)')} AS mean_diff FROM tgrid GROUP BY term", **_TGRID))
def _(b):
    mean = lambda k: F.avg(F.when(F.col("label") == k, F.col("value")))
    return _target_grid(b).groupBy("term").agg(r9(mean(0)).alias("mean0"), r9(mean(1)).alias("mean1"), *[F.count_if((F.col("label") == k) & (F.col("value") > 0)).alias(f"docs{k}") for k in (0, 1)], r9(mean(0) - mean(1)).alias("mean_diff"))


@query("o87_group_statistics", sql(f"SELECT label, CAST(sum(total) AS BIGINT) AS total, {q9('avg(total)')} AS mean, {q9('avg(CASE WHEN total > 0 THEN 1.0 ELSE 0.0 END)')} AS coverage FROM (SELECT doc_id, label, sum(tf) AS total FROM tgrid GROUP BY doc_id, label) GROUP BY label", **_TGRID))
def _(b):
    docs = _target_grid(b).groupBy("doc_id", "label").agg(F.sum("value").alias("total"))
    return docs.groupBy("label").agg(F.sum("total").alias("total"), r9(F.avg("total")).alias("mean"), r9(F.avg(F.when(F.col("total") > 0, 1.0).otherwise(0.0))).alias("coverage"))


@query("o88_percentile_exceedance", sql(f"SELECT term, {q9('thr')} AS threshold, {q9('avg(CASE WHEN tf > thr THEN 1.0 ELSE 0.0 END) FILTER (WHERE label = 0) - avg(CASE WHEN tf > thr THEN 1.0 ELSE 0.0 END) FILTER (WHERE label = 1)')} AS score FROM tgrid JOIN (SELECT term, quantile_cont(CAST(tf AS DOUBLE), 0.9) AS thr FROM tgrid WHERE label = 1 GROUP BY term) USING (term) GROUP BY term, thr", **_TGRID))
def _(b):
    grid = _target_grid(b)
    thr = stats.quantiles(grid.filter("label = 1").select(F.col("term").alias("grp"), F.col("value").cast("double").alias("v")), {"thr": 0.9})[1].select(F.col("grp").alias("term"), "thr")
    over = lambda k: F.avg(F.when(F.col("label") == k, F.when(F.col("value") > F.col("thr"), 1.0).otherwise(0.0)))
    return grid.join(F.broadcast(thr), "term").groupBy("term").agg(r9(F.max("thr")).alias("threshold"), r9(over(0) - over(1)).alias("score"))


@query("o89_fixed_threshold_exceedance", sql(f"SELECT t.term, t.thr, CASE WHEN d.term IS NULL THEN 'not in vocabulary' END AS problem, {q9('s')} AS score FROM (VALUES ('ing', 1), ('was', 2), ('nowhere', 1)) t(term, thr) LEFT JOIN dfs d ON d.term = t.term LEFT JOIN (SELECT g.term, avg(CASE WHEN tf > x.thr THEN 1.0 ELSE 0.0 END) FILTER (WHERE label = 0) - avg(CASE WHEN tf > x.thr THEN 1.0 ELSE 0.0 END) FILTER (WHERE label = 1) AS s FROM tgrid g JOIN (VALUES ('ing', 1), ('was', 2), ('nowhere', 1)) x(term, thr) ON g.term = x.term GROUP BY g.term) e ON e.term = t.term", **_TGRID))
def _(b):
    thr = b.spark.createDataFrame([("ing", 1), ("was", 2), ("nowhere", 1)], "term string, thr int")
    over = lambda k: F.avg(F.when(F.col("label") == k, F.when(F.col("value") > F.col("thr"), 1.0).otherwise(0.0)))
    score = _target_grid(b).join(F.broadcast(thr), "term").groupBy("term").agg(r9(over(0) - over(1)).alias("score"))
    known = b.post.filter(F.col("term").isin(["ing", "was", "nowhere"])).select("term").distinct().withColumn("known", F.lit(True))
    return thr.join(score, "term", "left").join(known, "term", "left").select("term", "thr", F.when(F.col("known").isNull(), "not in vocabulary").alias("problem"), "score")


@query("o90_exceedance_report", sql("SELECT thr, d.label, d.doc_id, d.total, words FROM (SELECT doc_id, label, sum(tf) AS total, string_agg(term || ':' || tf, ', ' ORDER BY term) FILTER (WHERE tf > 0) AS words FROM tgrid GROUP BY doc_id, label) d, (SELECT CAST(x.thr AS BIGINT) AS thr FROM (VALUES (5), (10), (20)) x(thr) UNION SELECT max(total) FROM (SELECT label, sum(tf) AS total FROM tgrid GROUP BY doc_id, label) WHERE label = 0) WHERE d.total > thr", **_TGRID))
def _(b):
    """Documents whose target words exceed a threshold, or the maximum of label 0, with their words; one row each."""
    grid = _target_grid(b)
    said = F.transform(F.sort_array(F.collect_list(F.when(F.col("value") > 0, F.struct("term", "value")))), lambda x: F.concat_ws(":", x["term"], x["value"].cast("string")))
    docs = kept(grid.groupBy("doc_id", "label").agg(F.sum("value").alias("total"), F.array_join(said, ", ").alias("words")))
    most = docs.filter("label = 0").agg(F.max("total").alias("most"))
    cuts = F.array_distinct(F.array_compact(F.array(*[F.lit(c).cast("long") for c in (5, 10, 20)], F.col("most"))))
    each = docs.crossJoin(F.broadcast(most)).withColumn("thr", F.explode(cuts)).filter("total > thr")
    return each.select("thr", "label", "doc_id", "total", "words")


_SCALED = {"tboth": "SELECT 'raw' AS matrix, doc_id, label, term, CAST(tf AS DOUBLE) AS v FROM tgrid UNION ALL SELECT 'min_max', doc_id, label, term, CASE WHEN hi > lo THEN (tf - lo) / (hi - lo) ELSE 0.0 END FROM (SELECT *, min(tf) OVER (PARTITION BY term) AS lo, max(tf) OVER (PARTITION BY term) AS hi FROM tgrid)"}
_TWICE = f"SELECT matrix, 'word' AS report, term AS name, label, {q9('avg(v)')} AS mean, count(*) FILTER (WHERE v > 0) AS docs, {q9('max(v)')} AS most FROM tboth GROUP BY matrix, term, label UNION ALL SELECT matrix, 'group', 'all', label, {q9('avg(total)')}, count(*) FILTER (WHERE total > 0), {q9('max(total)')} FROM (SELECT matrix, doc_id, label, sum(v) AS total FROM tboth GROUP BY matrix, doc_id, label) GROUP BY matrix, label"


@query("o215_reports_of_both_matrices", sql(_TWICE, **_TGRID, **_SCALED))
def _(b):
    """The word and the group report of the raw counts and of the whole set's min-max scale."""
    raw = kept(_target_grid(b).withColumn("value", F.col("value").cast("double")))
    scaled = M.min_max(raw, M.column_range(raw, b.sizes), clip=False)
    both = raw.withColumn("matrix", F.lit("raw")).unionByName(scaled.withColumn("matrix", F.lit("min_max")))
    summary = lambda rows, v: rows.agg(r9(F.avg(v)).alias("mean"), F.count_if(F.col(v) > 0).alias("docs"), r9(F.max(v)).alias("most"))
    words = summary(both.groupBy("matrix", F.lit("word").alias("report"), F.col("term").alias("name"), "label"), "value")
    totals = both.groupBy("matrix", "doc_id", "label").agg(F.sum("value").alias("total"))
    return words.unionByName(summary(totals.groupBy("matrix", F.lit("group").alias("report"), F.lit("all").alias("name"), "label"), "total"))


_MI = "(CASE WHEN a > 0 THEN a / n * ln(a * n / (df * nl)) ELSE 0.0 END)"


def _mi_cell(a: str, row: str, col: str) -> str:
    return f"(CASE WHEN {a} > 0 THEN CAST({a} AS DOUBLE) / n * ln(CAST({a} AS DOUBLE) * n / (CAST({row} AS DOUBLE) * {col})) ELSE 0.0 END)"


_MI_ALL = " + ".join([_mi_cell("df1", "df", "n1"), _mi_cell("df0", "df", "n0"), _mi_cell("(n1 - df1)", "(n - df)", "n1"), _mi_cell("(n0 - df0)", "(n - df)", "n0")])


@query("o91_presence_mutual_information", sql(f"SELECT * FROM (SELECT term, mi, CAST(row_number() OVER (ORDER BY mi DESC, term) AS INTEGER) AS rank FROM (SELECT term, {q9(_MI_ALL)} AS mi FROM dfs, sizes)) WHERE rank <= 50"))
def _(b):
    rows = M.document_frequency(b.post).crossJoin(F.broadcast(b.sizes)).select("term", r9(F.expr(_MI_ALL)).alias("mi"))
    return S.top(rows, ["mi DESC", "term"], 50, "rank")


_KNN = {
    "mp": "SELECT term, label, CAST(round(value * 1e9) AS BIGINT) AS v, 1 AS wt FROM weights WHERE round(value * 1e9) > 0",
    "mz": "SELECT term, y AS label, CASE WHEN y = 1 THEN n1 ELSE n0 END - c AS z FROM (SELECT t.term, y, count(mp.term) AS c FROM (SELECT DISTINCT term FROM mp) t CROSS JOIN (VALUES (1), (0)) l(y) LEFT JOIN mp ON mp.term = t.term AND mp.label = y GROUP BY t.term, y), sizes",
    "ma": "SELECT term, label, v, wt, count(*) OVER (PARTITION BY term, label, v) AS ties FROM mp UNION ALL SELECT term, label, 0, CASE WHEN i = 0 THEN z ELSE 0 END, z FROM (SELECT *, unnest(range(least(z, 4))) AS i FROM mz)",
    "mr": "SELECT term, v, wt, greatest(least(a, b, c, d) - 1, 0) AS r, CASE WHEN least(a, b, c, d) = 0 THEN ties ELSE 3 END AS k FROM (SELECT *, CASE WHEN lead(v, 3) OVER w IS NOT NULL THEN lead(v, 3) OVER w - v END AS a, CASE WHEN lag(v, 1) OVER w IS NOT NULL AND lead(v, 2) OVER w IS NOT NULL THEN greatest(v - lag(v, 1) OVER w, lead(v, 2) OVER w - v) END AS b, CASE WHEN lag(v, 2) OVER w IS NOT NULL AND lead(v, 1) OVER w IS NOT NULL THEN greatest(v - lag(v, 2) OVER w, lead(v, 1) OVER w - v) END AS c, CASE WHEN lag(v, 3) OVER w IS NOT NULL THEN v - lag(v, 3) OVER w END AS d FROM ma WINDOW w AS (PARTITION BY term, label ORDER BY v, wt))",
    "mc": "SELECT term, wt, k, sum(CASE WHEN v > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY term ORDER BY v RANGE BETWEEN r PRECEDING AND r FOLLOWING) + CASE WHEN v - r <= 0 THEN zs ELSE 0 END AS m FROM mr JOIN (SELECT term, sum(z) AS zs FROM mz GROUP BY term) USING (term)",
    "psi": "SELECT i AS m, coalesce(sum(1.0::DOUBLE / i) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) - 0.5772156649015329 AS p FROM (SELECT unnest(range(1, n + 2)) AS i FROM sizes)",
    "known": f"SELECT term, {q9('greatest(0.0, (SELECT p FROM psi WHERE m = n) - (n1 * (SELECT p FROM psi WHERE m = n1) + n0 * (SELECT p FROM psi WHERE m = n0)) / n + s / n)')} AS mi FROM (SELECT term, sum(wt * (a.p - b.p)) AS s FROM mc JOIN psi a ON a.m = mc.k JOIN psi b ON b.m = mc.m WHERE wt > 0 GROUP BY term), sizes",
}


@query("o91_knn_mutual_information", sql("SELECT term, mi, CAST(row_number() OVER (ORDER BY mi DESC, term) AS INTEGER) AS rank FROM known QUALIFY rank <= 143", **_KNN))
def _(b):
    """Continuous tf-idf weights, three neighbours; presence above is the discrete estimate."""
    return S.top(information.mutual_information(b.weights, b.sizes, 3), ["mi DESC", "term"], 143, "rank")


@query("o92_word_document_ranking", sql("SELECT doc_id, term, tf, CAST(row_number() OVER (ORDER BY tf DESC, term, doc_id) AS INTEGER) AS rank FROM post QUALIFY rank <= 200"))
def _(b):
    return S.top(b.post.select("doc_id", "term", "tf"), ["tf DESC", "term", "doc_id"], 200, "rank")


@query("o93_target_counts", sql("SELECT doc_id, label, term, tf AS n FROM tgrid WHERE tf > 0", **_TGRID))
def _(b):
    return b.post.filter(F.col("term").isin(_TARGETS)).select("doc_id", "label", "term", F.col("tf").alias("n"))


@query("o94_word_count_summary", sql(f"SELECT coalesce(CAST(label AS VARCHAR), 'all') AS grp, {q9('avg(words)')} AS mean, {q9('stddev_pop(words)')} AS std, min(words) AS low, {q9('quantile_cont(CAST(words AS DOUBLE), 0.5)')} AS median, max(words) AS high FROM wc GROUP BY GROUPING SETS ((label), ())"))
def _(b):
    own = b.corpus.select("label", T.word_count(F.col("text")).alias("words"))
    both = kept(own.select(F.explode(F.array(F.lit("all"), F.col("label").cast("string"))).alias("grp"), F.col("words").cast("double").alias("v"), "words"))
    summary = both.groupBy("grp").agg(r9(F.avg("words")).alias("mean"), r9(F.stddev_pop("words")).alias("std"), F.min("words").alias("low"), F.max("words").alias("high"))
    return summary.join(stats.quantiles(both.select("grp", "v"), {"median": 0.5})[1], "grp").select("grp", "mean", "std", "low", r9("median").alias("median"), "high")


query("o100_top_terms", sql("SELECT * FROM ranked WHERE selection_rank <= 100"))(lambda b: b.top(100))
query("o101_rank", sql("SELECT term, CAST(selection_rank AS BIGINT) AS selection_rank FROM ranked"))(lambda b: S.ranked(b.scores, S.SCORE_ORDER).select("term", "selection_rank"))


@query("o102_exclude_then_top", sql("SELECT term, CAST(row_number() OVER (ORDER BY abs_score DESC, selected_score DESC, label1_doc_count DESC, label0_doc_count DESC, term) AS INTEGER) AS selection_rank FROM scores WHERE term NOT IN (SELECT term FROM top30) QUALIFY selection_rank <= 40"))
def _(b):
    return S.top_excluding(b.scores, b.top(30), S.SCORE_ORDER, 40).select("term", "selection_rank")


query("o103_score_threshold", sql("SELECT term, abs_score, dominant_label FROM scores WHERE abs_score >= 0.05"))(lambda b: S.by_threshold(b.scores, 0.05).select("term", "abs_score", "dominant_label"))


@query("o104_balanced_top", sql("SELECT term, dominant_label, r AS selection_rank FROM (SELECT term, dominant_label, CAST(row_number() OVER (PARTITION BY dominant_label ORDER BY abs_score DESC, label1_doc_count DESC, label0_doc_count DESC, term) AS INTEGER) AS r FROM scores WHERE dominant_label <> 'neutral') WHERE r <= 20"))
def _(b):
    return S.balanced_top(b.scores, 40).select("term", "dominant_label", "selection_rank")


def _order(name: str, where: str, order: str, keys: list[str]):
    @query(name, sql(f"SELECT term, df1, df0, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS rank FROM dfs, sizes WHERE {where} QUALIFY rank <= 30"))
    def _(b):
        rows = M.document_frequency(b.post).crossJoin(F.broadcast(b.sizes)).filter(where).select("term", "df1", "df0")
        return S.top(rows, keys, 30, "rank")


_PARTS = {
    "parts": "SELECT doc_id, concat_ws('-', lang, source) AS part, CAST(1 - label AS INTEGER) AS label FROM corpus JOIN documents USING (doc_id)",
    "psizes": "SELECT part, count(*) FILTER (WHERE label = 1) AS n1 FROM parts GROUP BY part",
    "pdfs": "SELECT part, term, count(*) FILTER (WHERE parts.label = 1) AS df1, count(*) FILTER (WHERE parts.label = 0) AS df0 FROM post JOIN parts USING (doc_id) GROUP BY part, term",
}


@query("o105_all_label1_least_label0", sql("SELECT part, term, df1, df0, CAST(row_number() OVER (PARTITION BY part ORDER BY df0, term) AS INTEGER) AS rank FROM pdfs JOIN psizes USING (part) WHERE n1 > 0 AND df1 = n1 QUALIFY rank <= 30", **_PARTS))
def _(b):
    """Terms that every label-1 document has, of each source and language as a corpus of its own; label 1 is low quality here."""
    parts = b.table("documents").select("doc_id", F.concat_ws("-", "lang", "source").alias("part")).join(b.corpus.select("doc_id", (1 - F.col("label")).alias("label")), "doc_id")
    sizes = parts.groupBy("part").agg(F.count_if(F.col("label") == 1).alias("n1"))
    counts = b.post.select("doc_id", "term").join(parts, "doc_id").groupBy("part", "term").agg(F.count_if(F.col("label") == 1).alias("df1"), F.count_if(F.col("label") == 0).alias("df0"))
    rows = counts.join(sizes, "part").filter("n1 > 0 AND df1 = n1").drop("n1")
    return S.top(rows, ["df0", "term"], 30, "rank", ["part"])


_order("o106_absent_label1_most_label0", "df1 = 0", "df0 DESC, term", ["df0 DESC", "term"])
_order("o107_most_label0", "true", "df0 DESC, term", ["df0 DESC", "term"])
_order("o108_most_label1_least_label0", "true", "df1 DESC, df0, term", ["df1 DESC", "df0", "term"])
_order("o109_least_label1_most_label0", "true", "df1, df0 DESC, term", ["df1", "df0 DESC", "term"])


@query("o110_rate_difference", sql("SELECT * FROM (SELECT 'label1' AS way, term, label1_score AS rate, CAST(row_number() OVER (ORDER BY label1_score DESC, term) AS INTEGER) AS rank FROM scores UNION ALL SELECT 'label0', term, label0_score, CAST(row_number() OVER (ORDER BY label0_score DESC, term) AS INTEGER) FROM scores) WHERE rank <= 30"))
def _(b):
    way = lambda k: S.top(b.scores.select("term", F.col(f"label{k}_score").alias("rate")), ["rate DESC", "term"], 30, "rank").withColumn("way", F.lit(f"label{k}"))
    return way(1).unionByName(way(0))


def _specs(k: int, o: int) -> dict[str, str]:
    both = lambda m: f"label{k}_{m}_minus_label{o}_{m}"
    return {"tfidf_diff": both("mean_tfidf"), f"label{k}_mean_tfidf": f"label{k}_mean_tfidf", "count_diff": both("total_count"), "doc_diff": both("doc_count"), f"label{k}_total_count": f"label{k}_total_count", f"label{k}_doc_count": f"label{k}_doc_count", "mean_count_diff": both("mean_count"), "doc_rate_diff": both("doc_rate")}


_LISTS = " UNION ALL ".join(f"SELECT * FROM (SELECT 'label{k}' AS focus, term, '{n}' AS ranking_name, CAST(row_number() OVER (ORDER BY {c} DESC, term) AS INTEGER) AS rank FROM scout) WHERE rank <= 25" for k, o in ((1, 0), (0, 1)) for n, c in _specs(k, o).items())


@query("o111_ranking_overlap", sql(f"SELECT focus, term, count(*) AS appearance_count, string_agg(ranking_name, ', ' ORDER BY ranking_name) AS ranking_names, min(rank) AS best_rank, round(avg(rank), 9) AS average_rank FROM ({_LISTS}) GROUP BY focus, term", scout=_scout_sql()))
def _(b):
    scout = kept(_scout(b))
    of = lambda k, o: S.overlap(scout, _specs(k, o), 25).withColumn("focus", F.lit(f"label{k}"))
    return of(1, 0).unionByName(of(0, 1))


_NLISTS = " UNION ALL ".join(f"SELECT * FROM (SELECT n, 'label{k}' AS focus, term, CAST(row_number() OVER (PARTITION BY n ORDER BY {c} DESC, term) AS INTEGER) AS rank FROM nscout) WHERE rank <= 25" for k, o in ((1, 0), (0, 1)) for c in _specs(k, o).values())


@query("o112_overlap_of_all_ngrams", sql(f"SELECT focus, term, CAST(sum(appearances) AS BIGINT) AS total_appearance_count, count(DISTINCT n) AS ngram_count, string_agg(DISTINCT CAST(n AS VARCHAR), ', ' ORDER BY CAST(n AS VARCHAR)) AS ngrams, min(best) AS best_rank FROM (SELECT n, focus, term, count(*) AS appearances, min(rank) AS best FROM ({_NLISTS}) GROUP BY n, focus, term) GROUP BY focus, term", nscout=_scout_sql("npost", "nweights", "n").replace(", sizes)", ", (SELECT n1, n0 FROM sizes))"), **_NGRAMS))
def _(b):
    """The eight lists of either focus for each n-gram size from 1 to 5, then all sizes together."""
    scout, out = kept(_scout_ngrams(b)), None
    for k, o in ((1, 0), (0, 1)):
        names = F.explode(F.array(*[F.struct(F.lit(name).alias("list"), F.col(c).cast("double").alias("v")) for name, c in _specs(k, o).items()]))
        lists = S.top(scout.select("n", "term", names.alias("l")).select("n", "term", "l.*"), ["v DESC", "term"], 25, "rank", ["n", "list"])
        each = lists.groupBy("n", "term").agg(F.count(F.lit(1)).alias("appearances"), F.min("rank").alias("best")).withColumn("focus", F.lit(f"label{k}"))
        out = each if out is None else out.unionByName(each)
    sizes = F.array_join(F.sort_array(F.collect_set(F.col("n").cast("string"))), ", ")
    return out.groupBy("focus", "term").agg(F.sum("appearances").alias("total_appearance_count"), F.count_distinct("n").alias("ngram_count"), sizes.alias("ngrams"), F.min("best").alias("best_rank"))


_BI = "SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(list_transform(range(1, greatest(len(toks), 1)), lambda i: toks[i] || ' ' || toks[i + 1])) AS term FROM toks) GROUP BY term"


@query("o112_overall_overlap", sql("SELECT word, CAST(sum(df) AS BIGINT) AS total, count(DISTINCT n) AS sizes_seen, string_agg(DISTINCT n, ',' ORDER BY n) AS ngram_sizes, min(df) AS least FROM (SELECT term AS word, df, '1' AS n FROM dfs UNION ALL SELECT string_split(term, ' ')[1], df, '2' FROM bigrams) GROUP BY word", bigrams=_BI))
def _(b):
    one = b.post.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select(F.col("term").alias("word"), "df", F.lit("1").alias("n"))
    two = C.postings(b.toks(2, 2)).groupBy("term").agg(F.count(F.lit(1)).alias("df")).select(F.substring_index("term", " ", 1).alias("word"), "df", F.lit("2").alias("n"))
    return one.unionByName(two).groupBy("word").agg(F.sum("df").alias("total"), F.count_distinct("n").alias("sizes_seen"), F.array_join(F.sort_array(F.collect_set("n")), ",").alias("ngram_sizes"), F.min("df").alias("least"))


_CUTS = [0.0, 0.02, 0.05, 0.1, 0.5, 0.99]


@query("o113_threshold_summary", sql("SELECT t AS score_threshold, count(s.term) AS selected_term_count, count(s.term) FILTER (WHERE dominant_label = 'label1') AS label1_selected_term_count, count(s.term) FILTER (WHERE dominant_label = 'label0') AS label0_selected_term_count, count(s.term) FILTER (WHERE dominant_label = 'neutral') AS neutral_selected_term_count, max(m) AS max_abs_score, min(abs_score) AS min_selected_abs_score FROM (VALUES " + ", ".join(f"(CAST({c} AS DOUBLE))" for c in _CUTS) + ") x(t) CROSS JOIN (SELECT max(abs_score) AS m FROM scores) LEFT JOIN scores s ON s.abs_score >= t GROUP BY t"))
def _(b):
    return S.threshold_summary(b.scores, _CUTS)


_CUT_ROWS = ", ".join(f"(CAST({c} AS DOUBLE))" for c in _CUTS)


@query("o139_threshold_range_join", sql(f"SELECT score_threshold, dominant_label, count(*) AS terms FROM scores JOIN (VALUES {_CUT_ROWS}) x(score_threshold) ON abs_score >= score_threshold GROUP BY 1, 2"))
def _(b):
    return S.threshold_join(b.scores, b.spark.createDataFrame([(c,) for c in _CUTS], "score_threshold double"))


@query("o114_score_curve", sql("SELECT abs_score, label1_term_count_at_score, label0_term_count_at_score, neutral_term_count_at_score, term_count_at_score, CAST(sum(term_count_at_score) OVER w AS BIGINT) AS selected_term_count_at_or_above_score, CAST(sum(label1_term_count_at_score) OVER w AS BIGINT) AS label1_selected_term_count_at_or_above_score, CAST(sum(label0_term_count_at_score) OVER w AS BIGINT) AS label0_selected_term_count_at_or_above_score, CAST(sum(neutral_term_count_at_score) OVER w AS BIGINT) AS neutral_selected_term_count_at_or_above_score FROM (SELECT round(abs_score, 12) AS abs_score, count(*) FILTER (WHERE dominant_label = 'label1') AS label1_term_count_at_score, count(*) FILTER (WHERE dominant_label = 'label0') AS label0_term_count_at_score, count(*) FILTER (WHERE dominant_label = 'neutral') AS neutral_term_count_at_score, count(*) AS term_count_at_score FROM scores GROUP BY 1) WINDOW w AS (ORDER BY abs_score DESC ROWS UNBOUNDED PRECEDING)"))
def _(b):
    return S.score_curve(b.scores)


def _lists(b):
    first = S.ranked(b.scores.select("term", "abs_score"), ["abs_score DESC", "term"], "rank")
    second = S.ranked(M.document_frequency(b.post).select("term", "df"), ["df DESC", "term"], "rank")
    return tuple(x.select("term", F.col("rank").cast("int").alias("rank")) for x in (first, second))


query("o118_combined_unique")(lambda b: S.combined_unique(*_lists(b), 40))


@query("o119_combined_duplicate", sql("SELECT * FROM (SELECT 'first' AS selection_source, term, CAST(row_number() OVER (ORDER BY abs_score DESC, term) AS INTEGER) AS rank FROM scores) WHERE rank <= 20 UNION ALL SELECT * FROM (SELECT 'second', term, CAST(row_number() OVER (ORDER BY df DESC, term) AS INTEGER) AS rank FROM dfs) WHERE rank <= 20"))
def _(b):
    first, second = _lists(b)
    return first.filter("rank <= 20").withColumn("selection_source", F.lit("first")).unionByName(second.filter("rank <= 20").withColumn("selection_source", F.lit("second")))


_MODE_TABLES = {"term_frequency": difference("tfv", "tf", False), "document_frequency": difference("dfv", "df", False), "tfidf": difference("weights", "tfidf", False)}
_MODE_SQL = {f"from_{n}": f"SELECT term, CAST(row_number() OVER (ORDER BY absolute_difference DESC, term) AS BIGINT) AS source_rank, '{n}' AS selection_source FROM ({t})" for n, t in _MODE_TABLES.items()}


def _mode_part(mode: str, k: int) -> str:
    sources = S.MODES[mode][0]
    parts = " UNION ALL ".join(f"SELECT {i} AS place, * FROM from_{n} WHERE source_rank <= {k // len(sources)}" for i, n in enumerate(sources))
    return f"SELECT '{mode}' AS selection_mode, CAST(row_number() OVER (ORDER BY place, source_rank) AS INTEGER) AS selection_rank, term, selection_source, source_rank FROM ({parts})"


_PLAIN_MODES = [m for m, (_, unique) in S.MODES.items() if not unique]


def _modes(b, modes: list[str], k: int = 40):
    tables = {
        "term_frequency": X.difference_table(M.raw(b.post), None, "tf"),
        "document_frequency": X.difference_table(b.post.withColumn("value", F.lit(1.0)), None, "df"),
        "tfidf": X.difference_table(b.weights, None, "tfidf"),
    }
    tables = {n: kept(t.select("term", "absolute_difference")) for n, t in tables.items()}
    out = None
    for m in modes:
        own = S.by_mode(tables, m, k)
        out = own if out is None else out.unionByName(own)
    return out


query("o120_select_by_mode", sql(" UNION ALL ".join(f"SELECT * FROM ({_mode_part(m, 40)})" for m in _PLAIN_MODES), **_EXTRA, **_MODE_SQL))(lambda b: _modes(b, _PLAIN_MODES))
query("o120_unique_modes")(lambda b: _modes(b, [m for m in S.MODES if m not in _PLAIN_MODES]))
query("o124_sorted_scores", sql("SELECT term, abs_score, CAST(selection_rank AS BIGINT) AS selection_rank FROM ranked"))(lambda b: S.ranked(b.scores, S.SCORE_ORDER).select("term", "abs_score", "selection_rank"))


@query("o130_term_index_join", sql("SELECT doc_id, feature_index, tf FROM post JOIN (SELECT row_number() OVER (ORDER BY term) - 1 AS feature_index, term FROM top30) USING (term)"))
def _(b):
    index = b.top(30).select("term").orderBy("term").limit(30)
    from pyspark.sql import Window as W

    return b.post.join(F.broadcast(index.withColumn("feature_index", (F.row_number().over(W.orderBy("term")) - 1).cast("long"))), "term").select("doc_id", "feature_index", "tf")


query("o131_semi_join", sql("SELECT doc_id, term, tf FROM post WHERE term IN (SELECT term FROM top30)"))(lambda b: M.select_terms(b.post, b.top(30)).select("doc_id", "term", "tf"))
query("o132_anti_join", sql("SELECT term, df FROM dfs WHERE term NOT IN (SELECT term FROM top30)"))(lambda b: M.document_frequency(b.post).join(b.top(30).select("term"), "term", "left_anti").select("term", "df"))


@query("o133_left_join_metadata", sql("SELECT d.term, d.df, coalesce(r.selection_rank, -1) AS selection_rank, coalesce(r.dominant_label, '') AS role FROM dfs d LEFT JOIN (SELECT * FROM ranked WHERE selection_rank <= 30) r ON d.term = r.term"))
def _(b):
    meta = b.top(30).select("term", "selection_rank", "dominant_label")
    return M.document_frequency(b.post).join(F.broadcast(meta), "term", "left").select("term", "df", F.coalesce("selection_rank", F.lit(-1)).alias("selection_rank"), F.coalesce("dominant_label", F.lit("")).alias("role"))


@query("o134_names_join", sql("SELECT a.doc_id, b.doc_name, a.label FROM (SELECT doc_id, label, row_number() OVER (ORDER BY doc_id) AS place FROM corpus) a JOIN (SELECT doc_name, row_number() OVER (ORDER BY doc_id) AS place FROM corpus) b USING (place)"))
def _(b):
    """The listing of documents beside that of names, place by place."""
    names = b.corpus.select("doc_name", F.col("doc_id").alias("listed"))
    return C.by_position(b.corpus.select("doc_id", "label"), [F.col("doc_id")], names, [F.col("listed")]).select("doc_id", "doc_name", "label")


@query("o135_horizontal_concat", sql("SELECT w.doc_id, w.words, l.len_tokens FROM wc w JOIN lens l USING (doc_id)"))
def _(b):
    return b.corpus.select("doc_id", T.word_count(F.col("text")).alias("words")).join(b.lens.select("doc_id", "len_tokens"), "doc_id")


@query("o137_unique_vocabulary", sql("SELECT CASE WHEN df0 = 0 THEN 'label1' ELSE 'label0' END AS only_in, term, df FROM dfs WHERE df1 = 0 OR df0 = 0"))
def _(b):
    return M.document_frequency(b.post).filter("df1 = 0 OR df0 = 0").select(F.when(F.col("df0") == 0, "label1").otherwise("label0").alias("only_in"), "term", "df")


@query("o138_ordered_distinct", "SELECT source, min(doc_id) AS first_place FROM documents GROUP BY source")
def _(b):
    return b.table("documents").groupBy("source").agg(F.min("doc_id").alias("first_place"))


@query("o140_parameter_grid", sql("SELECT source, CAST(c AS DOUBLE) AS c, CAST(g AS DOUBLE) AS g, rows_of_source FROM (SELECT d.source, count(*) AS rows_of_source FROM documents d JOIN corpus USING (doc_id) GROUP BY d.source), (VALUES (0.01), (1.0), (100.0)) a(c), (VALUES (0.1), (1.0)) b(g)"))
def _(b):
    """Every parameter combination for each data set of labelled documents, as an experiment over data sets starts from."""
    from termforge.operators.models import grid

    sets = b.table("documents").select("doc_id", "source").join(b.corpus.select("doc_id"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("rows_of_source"))
    return sets.crossJoin(F.broadcast(grid(b.spark, {"c": [0.01, 1.0, 100.0], "gamma": [0.1, 1.0]}, "rbf"))).select("source", "c", F.col("gamma").alias("g"), "rows_of_source")


query("o141_label_split", sql("SELECT doc_id, term, tf FROM post WHERE label = 0"))(lambda b: b.post.filter("label = 0").select("doc_id", "term", "tf"))
query("o142_remove_row", sql("SELECT doc_id, label FROM corpus WHERE doc_id <> 152"))(lambda b: b.corpus.filter("doc_id <> 152").select("doc_id", "label"))
