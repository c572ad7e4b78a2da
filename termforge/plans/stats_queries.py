"""Statistics, splits, models and evaluation (O-116, O-121 .. O-123, O-150 .. O-215)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termforge.functions import text as T
from termforge.operators import boosting, components, contexts
from termforge.operators import evaluate as E
from termforge.operators import experiments, extensions
from termforge.operators import matrix as M
from termforge.operators import models, ranges
from termforge.operators import select as S
from termforge.operators import splits, stats
from termforge.operators.corpus import r9
from termforge.plans.base import Base
from termforge.plans.sql import sql
from termforge.plans.sql import r9 as q9
from termforge.sources import files
from termforge.operators.tables import kept, written

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Base(spark, sf_dir))
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


_IQR = "SELECT grp, q1, q3, count(*) AS n, count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers, max(v) AS top FROM {t} JOIN (SELECT grp, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM {t} GROUP BY grp) USING (grp) GROUP BY grp, q1, q3"


def _iqr_sql(source: str, **extra: str) -> str:
    return sql(f"SELECT grp, n, {q9('q1')} AS q1, {q9('q3')} AS q3, {q9('q3 - q1')} AS iqr, outliers, {q9('outliers / n')} AS outlier_rate, {q9('top')} AS max_value FROM ({_IQR.format(t=source)})", **extra)


@query("o150_iqr", _iqr_sql("ev", ev="SELECT event_type AS grp, CAST(value AS DOUBLE) AS v FROM events WHERE isfinite(value)"))
def _(b):
    return stats.iqr(b.table("events").select(F.col("event_type").alias("grp"), F.col("value").cast("double").alias("v")))


_GRID = {"grid": "SELECT c.doc_id, c.label, t.term, CAST(coalesce(r.value, 0.0) AS DOUBLE) AS v FROM corpus c CROSS JOIN (SELECT term FROM top30) t LEFT JOIN rel r ON r.doc_id = c.doc_id AND r.term = t.term"}
_TERMS = _GRID | {"tg": "SELECT term || '/all' AS grp, round(v, 9) AS v FROM grid UNION ALL SELECT term || '/label' || label AS grp, round(v, 9) AS v FROM grid"}


def _term_grid(b):
    """Documents by 30 selected terms."""
    return M.dense(M.relative(b.post, b.lens), b.corpus, b.top(30)).withColumn("v", F.round("value", 9))


def _term_counts(b):
    """label, term, v, c: how often a selected term has a share in documents of a label; documents without it are counted as zeros, not listed."""
    terms = b.top(30).select("term")
    some = M.relative(b.post.join(F.broadcast(terms), "term", "left_semi"), b.lens).groupBy("label", "term", F.round("value", 9).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    some = kept(some)
    every = terms.crossJoin(F.broadcast(b.sizes.select(F.explode(F.array(*[F.struct(F.lit(y).alias("label"), F.col(f"n{y}").alias("n")) for y in (1, 0)])).alias("x")).select("x.*")))  # two rows
    zeros = every.join(some.groupBy("label", "term").agg(F.sum("c").alias("there")), ["label", "term"], "left").select("label", "term", F.lit(0.0).alias("v"), (F.col("n") - F.coalesce("there", F.lit(0))).alias("c"))
    return some.unionByName(zeros.filter("c > 0"))


@query("o151_term_iqr", _iqr_sql("tg", **_TERMS))
def _(b):
    g = _term_counts(b)
    all_docs = g.select(F.concat("term", F.lit("/all")).alias("grp"), "v", "c")
    return stats.iqr(all_docs.unionByName(g.select(F.concat("term", F.lit("/label"), F.col("label").cast("string")).alias("grp"), "v", "c")))


@query("o152_outlier_rows", sql("SELECT doc_id, label, term, CASE WHEN v > q3 THEN 'high' ELSE 'low' END AS direction FROM (SELECT doc_id, label, term, round(v, 9) AS v FROM grid) JOIN (SELECT label, term, quantile_cont(round(v, 9), 0.25) AS q1, quantile_cont(round(v, 9), 0.75) AS q3 FROM grid GROUP BY label, term) USING (label, term) WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)", **_GRID))
def _(b):
    g = _term_grid(b).withColumn("grp", F.concat_ws("/", "label", "term"))
    _, q = stats.quartiles(_term_counts(b).select(F.concat_ws("/", "label", "term").alias("grp"), "v", "c"))
    width = F.col("q3") - F.col("q1")
    far = (F.col("v") < F.col("q1") - 1.5 * width) | (F.col("v") > F.col("q3") + 1.5 * width)
    return g.join(F.broadcast(q), "grp").filter(far).select("doc_id", "label", "term", F.when(F.col("v") > F.col("q3"), "high").otherwise("low").alias("direction"))


@query("o153_iqr_audit", sql(f"SELECT k, CAST(sum(outliers) AS BIGINT) AS outliers, count(*) FILTER (WHERE outliers > 0) AS terms_with_outliers, {q9('sum(outliers) / sum(n)')} AS rate, count(*) FILTER (WHERE abs(q3 - q1) <= 1e-8) AS flat FROM (SELECT selection_rank, x.* FROM ({_IQR.format(t='tg')}) x JOIN top30 ON grp = term || '/all'), (VALUES (10), (20), (30)) y(k) WHERE selection_rank <= k GROUP BY k", **_TERMS))
def _(b):
    ranked = b.top(30).select(F.concat("term", F.lit("/all")).alias("grp"), "selection_rank")
    g = stats.iqr(_term_counts(b).select(F.concat("term", F.lit("/all")).alias("grp"), "v", "c")).join(F.broadcast(ranked), "grp")
    each = g.withColumn("k", F.explode(F.array(*map(F.lit, (10, 20, 30))))).filter("selection_rank <= k")
    return each.groupBy("k").agg(F.sum("outliers").alias("outliers"), F.count_if(F.col("outliers") > 0).alias("terms_with_outliers"), r9(F.sum("outliers") / F.sum("n")).alias("rate"), F.count_if(F.abs("iqr") <= 1e-8).alias("flat"))


_W = "SELECT avg(v) FILTER (WHERE label = 1) AS m1, avg(v) FILTER (WHERE label = 0) AS m0, var_samp(v) FILTER (WHERE label = 1) AS v1, var_samp(v) FILTER (WHERE label = 0) AS v0, count(*) FILTER (WHERE label = 1) AS k1, count(*) FILTER (WHERE label = 0) AS k0 FROM (SELECT label, {v} AS v FROM wc)"


@query("o154_welch_t", sql(" UNION ALL ".join(f"SELECT '{n}' AS scale, {q9('(m1 - m0) / sqrt(v1 / k1 + v0 / k0)')} AS t, {q9('(v1 / k1 + v0 / k0) ** 2 / ((v1 / k1) ** 2 / (k1 - 1) + (v0 / k0) ** 2 / (k0 - 1))')} AS freedom FROM ({_W.format(v=v)})" for n, v in (("raw", "CAST(words AS DOUBLE)"), ("log1p", "ln(1 + words)")))))
def _(b):
    w = b.corpus.select("label", T.word_count(F.col("text")).cast("double").alias("v"))
    return stats.welch(w).withColumn("scale", F.lit("raw")).unionByName(stats.welch(w.withColumn("v", F.log1p("v"))).withColumn("scale", F.lit("log1p")))


@query("o155_mann_whitney_u", sql(f"SELECT {q9('sum(r) FILTER (WHERE label = 1) - k * (k + 1) / 2.0')} AS u FROM (SELECT label, rank() OVER (ORDER BY words) + (count(*) OVER (PARTITION BY words) - 1) / 2.0 AS r FROM wc), (SELECT count(*) AS k FROM wc WHERE label = 1) GROUP BY k"))
def _(b):
    return stats.mann_whitney(b.corpus.select("label", T.word_count(F.col("text")).alias("v")))


query("o156_permutation_test")(lambda b: stats.permutation(b.corpus.select("label", T.word_count(F.col("text")).cast("double").alias("v")), 100_000))


@query("o157_histogram", sql("SELECT label, least(29, CAST(floor((words - lo) * 30.0 / (hi - lo)) AS INTEGER)) AS bin, count(*) AS n FROM wc, (SELECT min(words) AS lo, max(words) AS hi FROM wc) GROUP BY 1, 2"))
def _(b):
    w = b.corpus.select("label", T.word_count(F.col("text")).alias("v"))
    return stats.histogram(w, 30)


@query("o159_pearson", sql(f"SELECT {q9('corr(words, label)')} AS r FROM wc"))
def _(b):
    return b.corpus.select("label", T.word_count(F.col("text")).alias("v")).agg(r9(F.corr("v", "label")).alias("r"))


query("o158_pca")(lambda b: stats.pca(b.table("embeddings").select("vec_id", "embedding", "label"), 5))
query("o158_pca_scores")(lambda b: stats.pca_fit(b.table("embeddings").select("vec_id", "embedding", "label"), 5)[0])



@query("o158_term_components")
def _(b):
    """The tf-idf matrix's first components, by terms; five passes, as its spectrum is flat beyond a few."""
    docs = b.corpus.select("doc_id", "label")
    scores, loadings, shares = components.principal(b.weights.select("doc_id", "term", "value"), docs, 3, passes=5)
    return components.report(scores, loadings, shares, docs)


query("o170_stratified_folds", sql("SELECT doc_id, label, fold FROM folds"))(lambda b: splits.stratified(b.corpus.select("doc_id", "label"), 5))


@query("o170_nested_folds", sql("SELECT o AS outer_fold, role, inner_fold, label, count(*) AS n FROM (SELECT o, label, 'train' AS role, CAST((row_number() OVER (PARTITION BY o, label ORDER BY doc_id) - 1) % 4 AS INTEGER) AS inner_fold FROM folds, (SELECT unnest(range(5))::INTEGER AS o) WHERE fold <> o UNION ALL SELECT o, label, 'test', -1 FROM folds, (SELECT unnest(range(5))::INTEGER AS o) WHERE fold = o) GROUP BY ALL"))
def _(b):
    return splits.nested(b.corpus.select("doc_id", "label"), 5, 4).groupBy("outer_fold", "role", "inner_fold", "label").agg(F.count(F.lit(1)).alias("n"))


query("o172_holdout_split", sql("SELECT doc_id, CASE WHEN h < 70 THEN 'train' WHEN h < 85 THEN 'validation' ELSE 'test' END AS role FROM (SELECT doc_id, CAST('0x' || substr(md5('split-' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS h FROM corpus)"))(lambda b: splits.holdout(b.corpus.select("doc_id"), 70))


query("o172_stratified_holdout", sql("SELECT doc_id, label, CASE WHEN (row_number() OVER (PARTITION BY label ORDER BY doc_id) - 1) % 10 = 0 THEN 'test' ELSE 'train' END AS role FROM corpus"))(lambda b: splits.stratified_holdout(b.corpus.select("doc_id", "label")))


@query("o171_leave_one_out", sql("SELECT c.doc_id AS test_id, c.label AS test_label, n - 1 AS train_rows, n1 - c.label AS train_label1, n - 1 AS inner_splits, (n - 1) * (n - 2) AS inner_train_rows FROM corpus c, sizes"))
def _(b):
    """The outer splits of the double leave-one-out, one row a test document; the pairs themselves are quadratic and stay implicit."""
    n = F.col("n")
    return splits.leave_one_out(b.corpus.select("doc_id", "label")).select("test_id", "test_label", (n - 1).alias("train_rows"), (F.col("n1") - F.col("test_label")).alias("train_label1"), (n - 1).alias("inner_splits"), ((n - 1) * (n - 2)).alias("inner_train_rows"))


def _once(build):
    """The rows of build(b), cached and the same object for one query, however often it asks."""

    def get(b):
        if build.__name__ not in b.__dict__:
            b.__dict__[build.__name__] = kept(build(b))
        return b.__dict__[build.__name__]

    return get


@_once
def _decisions(b):
    best = b.top(30).select("term", "label1_score")
    sums = b.post.join(F.broadcast(best), "term").groupBy("doc_id").agg(F.sum("label1_score").alias("w"))
    rows = b.corpus.select("doc_id", "label").join(sums, "doc_id", "left").withColumn("decision", r9(F.coalesce("w", F.lit(0.0)))).drop("w")
    return rows.join(splits.stratified(b.corpus.select("doc_id", "label"), 5).select("doc_id", "fold"), "doc_id").withColumn("predicted", F.when(F.col("decision") > 0, 1).otherwise(0))


_CELLS = "count(*) FILTER (WHERE label = 1 AND predicted = 1) AS tp, count(*) FILTER (WHERE label = 0 AND predicted = 0) AS tn, count(*) FILTER (WHERE label = 0 AND predicted = 1) AS fp, count(*) FILTER (WHERE label = 1 AND predicted = 0) AS fn"


def _metric_sql(counts: str) -> str:
    r = lambda a, b, n: f"{q9(f'CASE WHEN {b} > 0 THEN ({a}) / ({b}) ELSE 0.0 END')} AS {n}"
    return f"SELECT *, {r('tp + tn', 'tp + tn + fp + fn', 'accuracy')}, {r('tp', 'tp + fn', 'recall')}, {r('tp', 'tp + fp', 'precision')}, {r('2 * tp', '2 * tp + fp + fn', 'f1')} FROM ({counts})"


_FOLD = _metric_sql(f"SELECT fold, {_CELLS} FROM preds GROUP BY fold")


def _folds(b):
    return E.with_metrics(E.confusion(_decisions(b), ["fold"]))


query("o185_fold_metrics", sql(_FOLD))(_folds)
query("o186_pooled_metrics", sql(_metric_sql(f"SELECT {_CELLS} FROM preds")))(lambda b: E.with_metrics(E.confusion(_decisions(b), [])))
query("o187_macro_means", sql(f"SELECT {q9('avg(accuracy)')} AS accuracy, {q9('avg(f1)')} AS f1 FROM ({_FOLD})"))(lambda b: _folds(b).agg(r9(F.avg("accuracy")).alias("accuracy"), r9(F.avg("f1")).alias("f1")))


@query("o184_threshold_shift", sql(_metric_sql(f"SELECT t, {_CELLS} FROM (SELECT t, label, CASE WHEN decision > t THEN 1 ELSE 0 END AS predicted FROM margin, (VALUES (CAST(0.0 AS DOUBLE)), (-0.1), (-0.5), (-1.0), (-10.0)) x(t)) GROUP BY t")))
def _(b):
    each = _decisions(b).withColumn("t", F.explode(F.array(*map(F.lit, (0.0, -0.1, -0.5, -1.0, -10.0))))).withColumn("predicted", F.when(F.col("decision") > F.col("t"), 1).otherwise(0))
    return E.with_metrics(E.confusion(each, ["t"]))


@query("o188_roc_points", sql("SELECT decision, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp FROM (SELECT decision, sum(label) AS p, sum(1 - label) AS n FROM margin GROUP BY decision) WINDOW w AS (ORDER BY decision DESC ROWS UNBOUNDED PRECEDING)"))
def _(b):
    return stats.roc(_decisions(b))


@query("o188_pr_points", sql(f"SELECT decision, {q9('tp / (tp + fp)')} AS precision, {q9('tp / positives')} AS recall FROM (SELECT decision, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS positives FROM (SELECT decision, sum(label) AS p, sum(1 - label) AS n FROM margin GROUP BY decision) WINDOW w AS (ORDER BY decision DESC ROWS UNBOUNDED PRECEDING))"))
def _(b):
    return stats.precision_recall(_decisions(b))


@query("o188_auc", sql(f"SELECT {q9('(sum(r) FILTER (WHERE label = 1) - k1 * (k1 + 1) / 2.0) / (k1 * k0)')} AS auc FROM (SELECT label, rank() OVER (ORDER BY decision) + (count(*) OVER (PARTITION BY decision) - 1) / 2.0 AS r FROM margin), (SELECT count(*) FILTER (WHERE label = 1) AS k1, count(*) FILTER (WHERE label = 0) AS k0 FROM margin) GROUP BY k1, k0"))
def _(b):
    return stats.auc(_decisions(b))


@query("o193_misclassified", sql("SELECT doc_id, label, predicted, fold, decision FROM preds WHERE label <> predicted"))
def _(b):
    return _decisions(b).filter("label <> predicted").select("doc_id", "label", "predicted", "fold", "decision")


@query("o115_worst_misclassified", sql("SELECT doc_id, label, distance, CAST(row_number() OVER (ORDER BY distance DESC, doc_id) AS INTEGER) AS rank FROM (SELECT doc_id, label, abs(decision) AS distance FROM preds WHERE label <> predicted) QUALIFY rank <= 15"))
def _(b):
    wrong = _decisions(b).filter("label <> predicted").select("doc_id", "label", F.abs("decision").alias("distance"))
    return S.top(wrong, ["distance DESC", "doc_id"], 15, "rank")


@query("o201_margin_distance", sql(f"SELECT doc_id, {q9('-(2 * label - 1) * decision')} AS distance FROM preds WHERE label <> predicted"))
def _(b):
    return _decisions(b).filter("label <> predicted").select("doc_id", r9(-(2 * F.col("label") - 1) * F.col("decision")).alias("distance"))


@query("o176_margin_violations", sql(f"SELECT doc_id, label, doc_name, {q9('(2 * label - 1) * decision')} AS signed_margin FROM margin JOIN (SELECT doc_id, doc_name FROM corpus) USING (doc_id) WHERE (2 * label - 1) * decision < 0.05"))
def _(b):
    m = (2 * F.col("label") - 1) * F.col("decision")
    return _decisions(b).filter(m < 0.05).join(b.corpus.select("doc_id", "doc_name"), "doc_id").select("doc_id", "label", "doc_name", r9(m).alias("signed_margin"))


_CONTRIB = "SELECT p.doc_id, term, tf * label1_score AS c, CASE WHEN tf * label1_score > 0 THEN 'label1' WHEN tf * label1_score < 0 THEN 'label0' ELSE 'neutral' END AS effect, w.label, w.predicted FROM post p JOIN (SELECT term, label1_score FROM ranked WHERE selection_rank <= 30) USING (term) JOIN (SELECT doc_id, label, predicted FROM preds WHERE label <> predicted) w USING (doc_id)"
_ROLE = "CASE WHEN effect = 'label' || predicted THEN 'pushes_predicted_label' WHEN effect = 'label' || label THEN 'pushes_true_label' ELSE 'neutral' END"


def _contributions(b):
    best = b.top(30).select("term", "label1_score")
    wrong = _decisions(b).filter("label <> predicted").select("doc_id", F.col("label").alias("actual"), "predicted")
    c = F.col("tf") * F.col("label1_score")
    rows = b.post.select("doc_id", "term", "tf").join(F.broadcast(best), "term").join(wrong, "doc_id").withColumn("c", r9(c))
    effect = F.when(F.col("c") > 0, "label1").when(F.col("c") < 0, "label0").otherwise("neutral")
    role = F.when(effect == F.concat(F.lit("label"), F.col("predicted").cast("string")), "pushes_predicted_label").when(effect == F.concat(F.lit("label"), F.col("actual").cast("string")), "pushes_true_label").otherwise("neutral")
    return rows.withColumns({"role": role, "rank": F.row_number().over(W.partitionBy("doc_id").orderBy(F.abs("c").desc(), "term"))})


_RANKED_C = f"SELECT doc_id, term, {q9('c')} AS c, {_ROLE} AS role, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY abs({q9('c')}) DESC, term) AS INTEGER) AS rank FROM ({_CONTRIB})"
query("o123_contributions", sql(f"SELECT * FROM ({_RANKED_C}) WHERE rank <= 5"))(lambda b: _contributions(b).filter("rank <= 5").select("doc_id", "term", "c", "role", "rank"))
query("o191_effect_roles", sql(f"SELECT role, count(*) AS n FROM ({_RANKED_C}) GROUP BY role"))(lambda b: _contributions(b).groupBy("role").agg(F.count(F.lit(1)).alias("n")))
query("o192_top_feature_summary", sql(f"SELECT doc_id, string_agg(term || '(' || role || ')', ' | ' ORDER BY rank) AS summary FROM ({_RANKED_C}) WHERE rank <= 5 GROUP BY doc_id"))(
    lambda b: _contributions(b).filter("rank <= 5").groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.concat("term", F.lit("("), "role", F.lit(")")).alias("s")))), lambda x: x["s"]), " | ").alias("summary")))


@query("o116_nearest_vectors", "WITH q AS (SELECT vec_id AS qid, embedding AS e FROM embeddings WHERE vec_id % 20 = 0), d AS (SELECT qid, vec_id, round(sqrt(list_sum(list_transform(list_zip(e, embedding), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2])))), 6) AS dist FROM q, embeddings WHERE vec_id <> qid) SELECT qid, vec_id, dist + 0.0 AS dist, round(sqrt(greatest(0.0, 2 - 2 * exp(-0.1 * dist * dist))), 6) + 0.0 AS rbf_dist, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS INTEGER) AS rank FROM d QUALIFY rank <= 5")
def _(b):
    return stats.nearest(b.table("embeddings"), "vec_id % 20 = 0", 5, 0.1)


@query("o117_feature_match_rate", sql(f"SELECT label, {q9('avg(m)')} AS match_rate FROM (SELECT doc_id, label, 1 - (count(*) FILTER (WHERE a <> t)) / 30.0 AS m FROM (SELECT c.doc_id, c.label, coalesce(p.tf, 0) AS a, coalesce(q.tf, 0) AS t FROM corpus c CROSS JOIN (SELECT term FROM top30) x LEFT JOIN post p ON p.doc_id = c.doc_id AND p.term = x.term LEFT JOIN (SELECT term, tf FROM post WHERE doc_id = (SELECT min(doc_id) FROM corpus)) q ON q.term = x.term) GROUP BY doc_id, label) GROUP BY label"))
def _(b):
    grid = M.dense(M.raw(b.post), b.corpus, b.top(30))
    one = b.corpus.agg(F.min("doc_id").alias("doc_id"))
    target = grid.join(F.broadcast(one), "doc_id", "left_semi").select("term", F.col("value").alias("t"))
    docs = grid.join(F.broadcast(target), "term").groupBy("doc_id", "label").agg((F.count_if(F.col("value") == F.col("t")) / F.lit(30.0)).alias("m"))
    return docs.groupBy("label").agg(r9(F.avg("m")).alias("match_rate"))


# A table of results: documents scored by the summed scores of the first k terms, three ways of
# weighing a term and seven k, evaluated by fold; a candidate with a fold below 0.6 has no accuracy.
_WAYS, _KS, _LEAST = {"presence": "1", "frequency": "tf", "log_frequency": "(1 + ln(tf))"}, range(10, 80, 10), 0.6
_GAINS = "SELECT p.doc_id, tf, label1_score AS s, selection_rank AS r FROM post p JOIN ranked USING (term) WHERE selection_rank <= 70"
_TRIED = " UNION ALL ".join(f"SELECT '{w}' AS condition, {k} AS k, c.doc_id, c.label, round(coalesce(sum({e} * s), 0.0), 9) + 0.0 AS decision FROM corpus c LEFT JOIN gains g ON g.doc_id = c.doc_id AND r <= {k} GROUP BY c.doc_id, c.label" for w, e in _WAYS.items() for k in _KS)
_TRIED_FOLDS = "SELECT condition, k, f.fold, count(*) AS docs, count(*) FILTER (WHERE (decision > 0) <> (t.label = 1)) AS wrong FROM tried t JOIN folds f USING (doc_id) GROUP BY condition, k, f.fold"
_RES = f"SELECT condition, CAST(k AS VARCHAR) AS feature_count, {q9('avg(1 - wrong / docs)')} AS acc, CAST(sum(wrong) AS BIGINT) AS n, min(1 - wrong / docs) AS least FROM tried_folds GROUP BY condition, k"
_RESULTS = {"gains": _GAINS, "tried": _TRIED, "tried_folds": _TRIED_FOLDS, "res": f"SELECT condition, feature_count, CASE WHEN round(least, 9) < {_LEAST} THEN 'n/a' ELSE CAST(acc AS VARCHAR) END AS mean_accuracy, acc, n FROM ({_RES})"}


def _tried(b):
    """condition, k, doc_id, label, fold, decision of every candidate: one aggregate a document, all candidates in it."""
    best = b.top(70).select("term", "selection_rank", "label1_score")
    weight = {"presence": F.lit(1.0), "frequency": F.col("tf").cast("double"), "log_frequency": 1 + F.log("tf")}
    hits = b.post.select("doc_id", "term", "tf").join(F.broadcast(best), "term")
    names = [(w, k) for w in _WAYS for k in _KS]
    sums = hits.groupBy("doc_id").agg(*[F.sum(F.when(F.col("selection_rank") <= k, weight[w] * F.col("label1_score"))).alias(f"{w}{k}") for w, k in names])
    rows = b.corpus.select("doc_id", "label").join(sums, "doc_id", "left")
    each = F.explode(F.array(*[F.struct(F.lit(w).alias("condition"), F.lit(k).alias("k"), r9(F.coalesce(f"{w}{k}", F.lit(0.0))).alias("decision")) for w, k in names]))
    folds = splits.stratified(b.corpus.select("doc_id", "label"), 5).select("doc_id", "fold")
    return rows.select("doc_id", "label", each.alias("c")).select("doc_id", "label", "c.*").join(folds, "doc_id")


@_once
def _results(b):
    wrong = F.count_if((F.col("decision") > 0) != (F.col("label") == 1))
    folds = _tried(b).groupBy("condition", "k", "fold").agg(F.count(F.lit(1)).alias("docs"), wrong.alias("wrong"))
    share = 1 - F.col("wrong") / F.col("docs")
    rows = folds.groupBy("condition", "k").agg(r9(F.avg(share)).alias("acc"), F.sum("wrong").alias("n"), F.round(F.min(share), 9).alias("least"))
    return rows.select("condition", F.col("k").cast("string").alias("feature_count"), F.when(F.col("least") < _LEAST, "n/a").otherwise(F.col("acc").cast("string")).alias("mean_accuracy"), "acc", "n")


query("o121_best_row", sql("SELECT condition, feature_count, acc FROM res WHERE mean_accuracy <> 'n/a' QUALIFY row_number() OVER (PARTITION BY condition ORDER BY acc DESC, CAST(feature_count AS BIGINT)) = 1", **_RESULTS))(lambda b: S.best_rows(_results(b), ["condition"]).select("condition", "feature_count", "acc"))
query("o122_filter_sort_top", sql("SELECT condition, feature_count, acc, CAST(row_number() OVER (ORDER BY acc DESC, condition, feature_count) AS INTEGER) AS rank FROM res WHERE n > 2 QUALIFY rank <= 10", **_RESULTS))(lambda b: S.top(_results(b).filter("n > 2").select("condition", "feature_count", "acc"), ["acc DESC", "condition", "feature_count"], 10, "rank"))
query("o189_status_counts", sql("SELECT CASE WHEN mean_accuracy = 'n/a' THEN 'dropped' ELSE 'valid' END AS status, count(*) AS n FROM res GROUP BY 1", **_RESULTS))(lambda b: _results(b).groupBy(F.when(F.col("mean_accuracy") == "n/a", "dropped").otherwise("valid").alias("status")).agg(F.count(F.lit(1)).alias("n")))
query("o181_best_candidate", sql("SELECT condition, feature_count AS param_label, acc FROM res QUALIFY row_number() OVER (PARTITION BY condition ORDER BY acc DESC, feature_count) = 1", **_RESULTS))(lambda b: S.top(_results(b), ["acc DESC", "feature_count"], 1, "nth", ["condition"]).select("condition", F.col("feature_count").alias("param_label"), "acc"))
query("o205_earliest_best", sql("SELECT condition, feature_count, acc FROM res QUALIFY row_number() OVER (PARTITION BY condition ORDER BY acc DESC, CAST(feature_count AS INTEGER)) = 1", **_RESULTS))(lambda b: S.top(_results(b).withColumn("i", F.col("feature_count").cast("int")), ["acc DESC", "i"], 1, "nth", ["condition"]).select("condition", "feature_count", "acc"))
query("o194_repeated_errors", sql("SELECT doc_id, label, count(*) AS n FROM tried WHERE (decision > 0) <> (label = 1) GROUP BY doc_id, label HAVING count(*) >= 6", **_RESULTS))(lambda b: _tried(b).filter((F.col("decision") > 0) != (F.col("label") == 1)).groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("n")).filter("n >= 6"))
query("o195_group_candidates", sql(f"SELECT condition, {q9('m')} AS mean_accuracy FROM (SELECT condition, avg(acc) AS m FROM res GROUP BY condition HAVING count(*) > 5) QUALIFY rank() OVER (ORDER BY {q9('m')} DESC) = 1", **_RESULTS))(
    lambda b: _results(b).groupBy("condition").agg(F.count(F.lit(1)).alias("k"), r9(F.avg("acc")).alias("mean_accuracy")).filter("k > 5").withColumn("r", F.rank().over(W.orderBy(F.col("mean_accuracy").desc()))).filter("r = 1").select("condition", "mean_accuracy"))
query("o196_accuracy_lift", sql(f"SELECT r.condition, feature_count, {q9('acc - base')} AS lift FROM res r LEFT JOIN (SELECT condition, acc AS base FROM res WHERE feature_count = '10') z ON z.condition = r.condition", **_RESULTS))(
    lambda b: _results(b).join(F.broadcast(_results(b).filter("feature_count = '10'").select("condition", F.col("acc").alias("base"))), "condition", "left").select("condition", "feature_count", r9(F.col("acc") - F.col("base")).alias("lift")))
query("o197_counts_by_fold", sql("SELECT condition, round(avg(n), 3) AS mean_count, string_agg(n, ',' ORDER BY feature_count) AS counts FROM res GROUP BY condition", **_RESULTS))(
    lambda b: _results(b).groupBy("condition").agg(F.round(F.avg("n"), 3).alias("mean_count"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("feature_count", "n"))), lambda x: x["n"].cast("string")), ",").alias("counts")))
query("o198_report_with_average", sql("SELECT condition, feature_count, round(acc, 3) AS accuracy FROM res UNION ALL SELECT condition, 'average', round(avg(acc), 3) FROM res GROUP BY condition", **_RESULTS))(
    lambda b: _results(b).select("condition", "feature_count", F.round("acc", 3).alias("accuracy")).unionByName(_results(b).groupBy("condition").agg(F.round(F.avg("acc"), 3).alias("accuracy")).withColumn("feature_count", F.lit("average"))))
#: All conditions of an experiment, tried or not.
_CONDITIONS = [*_WAYS, "binary_log"]


@query("o203_condition_summary", sql(f"SELECT c.condition, count(r.condition) AS candidates, count(*) FILTER (WHERE mean_accuracy <> 'n/a') AS valid, count(*) FILTER (WHERE mean_accuracy = 'n/a') AS dropped, {q9('max(acc) FILTER (WHERE mean_accuracy <> ' + chr(39) + 'n/a' + chr(39) + ')')} AS best, {q9('avg(acc) FILTER (WHERE mean_accuracy <> ' + chr(39) + 'n/a' + chr(39) + ')')} AS mean, coalesce(string_agg(feature_count, ',' ORDER BY feature_count) FILTER (WHERE mean_accuracy <> 'n/a'), '') AS feature_counts FROM (VALUES {', '.join(f"('{c}')" for c in _CONDITIONS)}) c(condition) LEFT JOIN res r ON r.condition = c.condition GROUP BY c.condition", **_RESULTS))
def _(b):
    """A condition without a valid candidate, or without any, stays with blanks."""
    known = b.spark.createDataFrame([(c,) for c in _CONDITIONS], "condition string")
    good = lambda x: F.when(F.col("mean_accuracy") != "n/a", x)
    found = known.join(_results(b), "condition", "left").groupBy("condition")
    counts = F.array_join(F.sort_array(F.collect_list(good(F.col("feature_count")))), ",")
    return found.agg(F.count("acc").alias("candidates"), F.count_if(F.col("mean_accuracy") != "n/a").alias("valid"), F.count_if(F.col("mean_accuracy") == "n/a").alias("dropped"), r9(F.max(good(F.col("acc")))).alias("best"), r9(F.avg(good(F.col("acc")))).alias("mean"), counts.alias("feature_counts"))


@query("o196_lift_over_prior", sql(f"SELECT 'candidate' AS phase, r.condition, feature_count, CASE WHEN mean_accuracy <> 'n/a' THEN round(r.acc - p.prior, 9) + 0.0 END AS lift FROM res r, (SELECT {q9('greatest(n1, n0) / n')} AS prior FROM sizes) p UNION ALL SELECT 'total', '', CAST(count(*) AS VARCHAR), NULL FROM res", **_RESULTS))
def _(b):
    """Lift over the accuracy of always predicting the larger class; null where a candidate has no accuracy. The last row is the total's."""
    prior = b.sizes.select(r9(F.greatest("n1", "n0") / F.col("n")).alias("prior"))
    lift = F.when(F.col("mean_accuracy") != "n/a", r9(F.col("acc") - F.col("prior")))
    rows = _results(b).crossJoin(F.broadcast(prior)).select(F.lit("candidate").alias("phase"), "condition", "feature_count", lift.alias("lift"))
    return rows.unionByName(_results(b).agg(F.lit("total").alias("phase"), F.lit("").alias("condition"), F.count(F.lit(1)).cast("string").alias("feature_count"), F.lit(None).cast("double").alias("lift")).select("phase", "condition", "feature_count", "lift"))


@query("o196_threshold_accuracy_map", sql(f"SELECT condition AS kernel, CAST(feature_count AS INTEGER) AS threshold, CASE WHEN mean_accuracy = 'n/a' THEN '' ELSE mean_accuracy END AS accuracy, CAST(row_number() OVER (ORDER BY condition, CAST(feature_count AS INTEGER)) AS INTEGER) AS place FROM res WHERE feature_count <> '10'", **_RESULTS))
def _(b):
    """The fixed candidates alone (the first is the baseline), by kernel and threshold."""
    rows = _results(b).filter("feature_count <> '10'").select(F.col("condition").alias("kernel"), F.col("feature_count").cast("int").alias("threshold"), F.when(F.col("mean_accuracy") == "n/a", "").otherwise(F.col("mean_accuracy")).alias("accuracy"))
    return ranges.numbered(rows, [F.col("kernel"), F.col("threshold")], "place").withColumn("place", F.col("place").cast("int"))


query("o207_kernel_summary", sql(f"SELECT condition, {q9('avg(acc)')} AS mean, {q9('stddev_pop(acc)')} AS std, string_agg(feature_count, ';' ORDER BY feature_count) AS params FROM res GROUP BY condition", **_RESULTS))(
    lambda b: _results(b).groupBy("condition").agg(r9(F.avg("acc")).alias("mean"), r9(F.stddev_pop("acc")).alias("std"), F.array_join(F.sort_array(F.collect_list("feature_count")), ";").alias("params")))


@query("o206_threshold_counts_by_fold", sql("SELECT fold, t, count(*) FILTER (WHERE s >= t) AS selected FROM (SELECT fold, abs(c1 / k1 - c0 / k0) AS s FROM (SELECT f.fold, term, count(*) FILTER (WHERE p.label = 1) AS c1, count(*) FILTER (WHERE p.label = 0) AS c0 FROM post p JOIN folds f USING (doc_id) GROUP BY f.fold, term) JOIN (SELECT fold, count(*) FILTER (WHERE label = 1) AS k1, count(*) FILTER (WHERE label = 0) AS k0 FROM folds GROUP BY fold) USING (fold)), (VALUES (CAST(0.031 AS DOUBLE)), (0.107), (0.313)) x(t) GROUP BY fold, t"))
def _(b):
    folds = splits.stratified(b.corpus.select("doc_id", "label"), 5)
    sizes = folds.groupBy("fold").agg(F.count_if(F.col("label") == 1).alias("k1"), F.count_if(F.col("label") == 0).alias("k0"))
    counts = b.post.join(folds.select("doc_id", "fold"), "doc_id").groupBy("fold", "term").agg(F.count_if(F.col("label") == 1).alias("c1"), F.count_if(F.col("label") == 0).alias("c0"))
    s = counts.join(F.broadcast(sizes), "fold").select("fold", F.abs(F.col("c1") / F.col("k1") - F.col("c0") / F.col("k0")).alias("s"))
    return s.withColumn("t", F.explode(F.array(F.lit(0.031), F.lit(0.107), F.lit(0.313)))).groupBy("fold", "t").agg(F.count_if(F.col("s") >= F.col("t")).alias("selected"))


query("o214_display_format", "SELECT event_id, CASE WHEN value IS NULL THEN '' ELSE regexp_replace(regexp_replace(printf('%.3f', round(value, 3)), '0+$', ''), '\\.$', '') END AS shown FROM events")(
    lambda b: b.table("events").select("event_id", F.coalesce(F.regexp_replace(F.regexp_replace(F.format_string("%.3f", F.round("value", 3)), "0+$", ""), r"\.$", ""), F.lit("")).alias("shown")))


_FOLD_TERMS = {
    "fc": "SELECT f.fold, term, count(*) FILTER (WHERE p.label = 1) AS c1, count(*) FILTER (WHERE p.label = 0) AS c0 FROM post p JOIN folds f USING (doc_id) GROUP BY f.fold, term",
    "fn": "SELECT fold, count(*) FILTER (WHERE label = 1) AS k1, count(*) FILTER (WHERE label = 0) AS k0 FROM folds GROUP BY fold",
    "train": "SELECT fn.fold, d.term, round(abs((df1 - coalesce(c1, 0)) / (n1 - k1) - (df0 - coalesce(c0, 0)) / (n0 - k0)), 9) + 0.0 AS s FROM fn CROSS JOIN dfs d CROSS JOIN sizes LEFT JOIN fc ON fc.fold = fn.fold AND fc.term = d.term",
}


OUTER, INNER, TERMS = 5, 3, 20


def _contexts(b, outer: int = OUTER, inner: int = INNER, k: int = TERMS, consistent: bool = False, outermost: bool = False):
    """Rows of all contexts, or only of the outermost; a context's terms are chosen on its own training rows. consistent: without
    documents whose features stand in their context's training rows under both labels, which no gate can pass."""
    post = kept(b.post.select("doc_id", "term", "tf"))

    def build():
        roles = contexts.roles(b.corpus.select("doc_id", "label"), outer, inner)
        roles = kept(roles.filter("inner_fold = -1") if outermost else roles)
        return contexts.features(post, roles, contexts.selected(post, roles, k), k)

    if b.cache:  # by content: other settings, documents, labels or terms are another table
        rows = files.cached(b.spark, b.cache, files.content_key({"outer": outer, "inner": inner, "terms": k} | ({"outermost": True} if outermost else {}), b.post), build)
        return contexts.consistent(rows) if consistent else rows
    rows = written(build())  # read several times by each evaluation
    return contexts.consistent(rows) if consistent else rows


#: Enough terms for candidates that separate every training row.
MANY = 400


def _outer(b, k: int = TERMS, consistent: bool = False):
    return _contexts(b, k=k, consistent=consistent, outermost=True)


def _fits(b, kernel: str, values: dict, margin=None, accuracy: bool = False, k: int = TERMS, consistent: bool = False):
    return models.evaluate(_outer(b, k, consistent), models.grid(b.spark, values, kernel), margin, accuracy, 1e-6)


_LINEAR, _RBF = {"c": [0.01, 1.0]}, {"c": [1.0, 100.0], "gamma": [0.1, 1.0]}
_VALID = "outer_fold", "candidate_index", "param_label", "doc_id", "label", "status", "decision", "predicted"
query("o173_svc_linear")(lambda b: _fits(b, "linear", _LINEAR).select(*_VALID))
query("o174_svc_rbf")(lambda b: _fits(b, "rbf", _RBF).select(*_VALID))
query("o174_svc_sigmoid")(lambda b: _fits(b, "sigmoid", {"c": [1.0], "gamma": [0.01, 0.1]}).select(*_VALID))
query("o175_margin_gate")(lambda b: _fits(b, "rbf", _RBF, models.MARGIN, k=MANY, consistent=True).groupBy("outer_fold", "candidate_index").agg(F.first("status").alias("status")))
query("o212_train_accuracy_gate")(lambda b: models.gate_statuses(_outer(b, MANY), models.grid(b.spark, _RBF, "rbf"), None, True, 1e-6).select("outer_fold", "candidate_index", "status"))


query("o180_candidate_evaluation")(lambda b: models.candidate_records(_contexts(b), models.grid(b.spark, {"c": [0.01, 0.1, 1.0]}), None, tol=1e-6)[0])
query("o182_nested_cv")(lambda b: models.nested_cv(_contexts(b), models.grid(b.spark, {"c": [0.01, 0.1, 1.0]}), None, tol=1e-6))


def _gated(b):
    """Records and statuses with the gate on, of rows that some candidates separate by the margin and some don't."""
    return models.candidate_records(_contexts(b, k=MANY, consistent=True), models.grid(b.spark, _RBF, "rbf"), models.MARGIN, tol=1e-6)


query("o180_gated_records")(lambda b: _gated(b)[0])
query("o182_gated_nested_cv")(lambda b: models.select_best(_gated(b)[0]))
query("o189_candidate_status")(lambda b: _gated(b)[1])
query("o183_pooled_grid_search")(lambda b: E.with_metrics(E.confusion(models.pooled_grid_search(_contexts(b), models.grid(b.spark, {"kernel": ["linear", "rbf"], "c": [0.1, 1, 5], "gamma": [0.01, 0.001]})), [])))
query("o183_pooled_whole_grid")(lambda b: E.with_metrics(E.confusion(models.pooled_grid_search(_contexts(b, OUTER, 10), models.grid(b.spark, models.POOLED_GRID)), [])))
query("o200_fit_one_split")(lambda b: E.with_metrics(E.confusion(models.evaluate(_outer(b).filter("outer_fold = 0"), models.grid(b.spark, {"c": [1.0]}), None, tol=1e-6), ["status"])))
query("o204_unnested_search")(lambda b: _unnested(b))


def _unnested(b):
    """Combinations that reproduce every training label, with the mean accuracy of fixed folds; the first strictly better one wins."""
    found = kept(_fits(b, "rbf", _RBF, None, True, MANY, True))
    whole = found.groupBy("candidate_index", "param_label").agg(F.bool_and(F.col("status") != "invalid_accuracy").alias("whole")).filter("whole").drop("whole")
    scores = E.with_metrics(E.confusion(found, ["outer_fold", "candidate_index"])).groupBy("candidate_index").agg(r9(F.avg("accuracy")).alias("accuracy"))
    return S.top(scores.join(whole, "candidate_index"), ["accuracy DESC", "candidate_index"], 1, "nth").drop("nth")


def _thresholds(b, seconds=None):
    cuts = [0.2, 0.3]
    roles = kept(contexts.roles(b.corpus.select("doc_id", "label"), 3, 2))
    records, statuses = experiments.threshold_records(b.post, roles, cuts, models.grid(b.spark, _LINEAR), 60, None, 1e-6, seconds)
    return records, statuses, b.spark.createDataFrame([(c,) for c in cuts], "score_threshold double")


@query("o209_fixed_and_tuned")
def _(b):
    records, _, cuts = _thresholds(b)
    return experiments.fixed_and_tuned(records, cuts)


query("o210_fit_statuses")(lambda b: _thresholds(b, 7200.0)[1])
query("o190_attributions")(lambda b: models.attributions(_outer(b), "linear", 1.0))
query("o190_attributions_rbf")(lambda b: models.attributions(_outer(b), "rbf", 1.0, 0.1))


@query("o211_error_statuses")
def _(b):
    rows = _outer(b)
    return models.error_statuses(models.evaluate(rows, models.grid(b.spark, {"c": [1.0]}), None, tol=1e-6), models.attributions(rows, "linear", 1.0).select("outer_fold", "doc_id").distinct())


@query("o213_leaf_neighbourhood")
def _(b):
    from termforge.operators import native_models

    # label 0 is the rarer one here and the one that forests miss
    flipped = kept(_outer(b).withColumn("label", 1 - F.col("label")))
    out = None
    for k in range(OUTER):
        own = native_models.leaf_neighbourhood(flipped.filter(F.col("outer_fold") == k)).withColumn("outer_fold", F.lit(k))
        out = own if out is None else out.unionByName(own)
    return out


def _native(b, kind: str):
    """Predictions for every labelled document, each by the model of its outer fold's training rows."""
    from termforge.operators import native_models

    rows = kept(_outer(b))
    out = None
    for k in range(OUTER):
        own = native_models.predict(rows.filter(F.col("outer_fold") == k), kind).withColumn("outer_fold", F.lit(k))
        out = own if out is None else out.unionByName(own)
    return out


for _k, _n in (("forest", "o179_random_forest"), ("logistic", "o179_logistic_regression")):
    query(_n)(lambda b, k=_k: _native(b, k))


#: Short grids of the two boosters; the full ones are boosting.LEAF_GRID and boosting.DEPTH_GRID.
_LEAF = {"n_estimators": [4, 8], "num_leaves": [5], "max_depth": [-1], "learning_rate": [0.3]}
_DEPTH = {"n_estimators": [4, 8], "max_depth": [3], "learning_rate": [0.3], "min_child_weight": [0, 3]}
query("o177_gradient_boosting")(lambda b: boosting.evaluate(_outer(b), boosting.grid(b.spark, _LEAF, "leaf"), None).select(*_VALID))
query("o178_weighted_boosting")(lambda b: boosting.evaluate(_outer(b), boosting.grid(b.spark, _DEPTH, "depth"), None).select(*_VALID))


@query("o177_boosting_grid")
def _(b):
    """Gate of raw scores and choice by inner folds; conflicting copies are left out, so that a training set can be separated."""
    rows = _contexts(b, 3, 2, 100, consistent=True)
    records, statuses = models.candidate_records(rows, boosting.grid(b.spark, {"n_estimators": [1, 3], "num_leaves": [127], "max_depth": [-1], "learning_rate": [0.4]}, "leaf"), models.MARGIN, run=boosting.evaluate)
    best = models.select_best(records).select("outer_fold", "candidate_index", "accuracy")
    return statuses.join(best, "candidate_index", "left").select("candidate_index", "param_label", "status", "outer_fold", "accuracy")


_ROOT = """SELECT fold, term, c1, c0, m1, m0, w, selection_rank, pow(0.5 * (m0 - c0) - 0.5 * w * (m1 - c1), 2) / (0.25 * (m0 - c0 + w * (m1 - c1))) + pow(0.5 * c0 - 0.5 * w * c1, 2) / (0.25 * (c0 + w * c1)) AS gain
 FROM (SELECT r.fold, r.term, r.selection_rank, df1 - coalesce(c1, 0) AS c1, df0 - coalesce(c0, 0) AS c0, n1 - k1 AS m1, n0 - k0 AS m0, (n0 - k0) / (n1 - k1) AS w
 FROM (SELECT fold, term, row_number() OVER (PARTITION BY fold ORDER BY s DESC, term) AS selection_rank FROM train QUALIFY selection_rank <= 20) r JOIN dfs USING (term) JOIN fn USING (fold) CROSS JOIN sizes LEFT JOIN fc ON fc.fold = r.fold AND fc.term = r.term)
 WHERE c1 + c0 > 0 AND c1 + c0 < m1 + m0"""


@query("o178_root_splits", sql("SELECT fold AS outer_fold, term, round(gain, 4) AS gain, round(2 * (0.3 * (w * (m1 - c1) - (m0 - c0)) / (m0 - c0 + w * (m1 - c1))), 5) + 0.0 AS absent, round(2 * (0.3 * (w * c1 - c0) / (c0 + w * c1)), 5) + 0.0 AS present FROM root QUALIFY row_number() OVER (PARTITION BY fold ORDER BY gain DESC, selection_rank) = 1", root=_ROOT, **_FOLD_TERMS))
def _(b):
    """The first cut of the first tree of each outer fold: gain, and the steps of rows without and with the term."""
    roles = kept(contexts.roles(b.corpus.select("doc_id", "label"), OUTER, INNER).filter("inner_fold = -1"))
    post = b.post.select("doc_id", "term", "tf")
    terms = kept(contexts.selected(post, roles, TERMS))
    found, _ = boosting.fit(contexts.features(post, roles, terms, TERMS), [boosting.Series("depth", 1, 2, 0.3, 0.0)], 1)
    cuts = [(key[0], own[0][0].nodes[1]) for key, own in found.items() if 1 in own[0][0].nodes]
    rows = b.spark.createDataFrame([(o, n.feature + 1, round(n.gain, 4), round(n.values[0], 5) + 0.0, round(n.values[1], 5) + 0.0) for o, n in cuts], "outer_fold int, selection_rank int, gain double, absent double, present double")
    return terms.join(F.broadcast(rows), ["outer_fold", "selection_rank"]).select("outer_fold", "term", "gain", "absent", "present")


_FAR = "round(sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2])))), 6)"


@query("o179_local_outlier_factor", f"WITH x AS (SELECT vec_id, embedding AS e FROM embeddings), d AS (SELECT a.vec_id AS qid, b.vec_id, {_FAR} AS dist FROM x a, x b WHERE a.vec_id <> b.vec_id), g AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) <= 5), k AS (SELECT qid AS vec_id, max(dist) AS kth FROM g GROUP BY qid), r AS (SELECT qid, 1 / (avg(greatest(dist, kth)) + 1e-10) AS density FROM g JOIN k USING (vec_id) GROUP BY qid), o AS (SELECT g.qid, avg(r.density) AS others FROM g JOIN r ON r.qid = g.vec_id GROUP BY g.qid) SELECT qid AS vec_id, round(density, 6) AS density, round(others / density, 6) AS factor FROM o JOIN r USING (qid) WHERE qid % 20 = 0")
def _(b):
    return stats.local_outlier_factor(b.table("embeddings"), "vec_id % 20 = 0", 5)


query("o179_one_class_svm")(lambda b: models.one_class(_outer(b), "rbf", [0.1, 0.5]))


@query("o171_leave_one_out_evaluated")
def _(b):
    """Every labelled document by a classifier of all others, on the strongest terms."""
    terms = b.top(TERMS).select("term", "selection_rank")
    rows = contexts.features(b.post.select("doc_id", "term", "tf"), b.corpus.select(F.lit(0).alias("outer_fold"), F.lit(-1).alias("inner_fold"), "doc_id", F.lit("train").alias("role"), "label"), terms.withColumns({"outer_fold": F.lit(0), "inner_fold": F.lit(-1)}), TERMS)
    return models.leave_one_out(rows, "linear", 1.0)


@query("o179_knn", "WITH q AS (SELECT vec_id AS qid, label AS actual, embedding AS e FROM embeddings WHERE vec_id % 20 = 0), d AS (SELECT qid, actual, label, vec_id, round(sqrt(list_sum(list_transform(list_zip(e, embedding), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2])))), 6) AS dist FROM q, embeddings WHERE vec_id <> qid), n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS r FROM d), v AS (SELECT qid, actual, label, count(*) AS votes FROM n WHERE r <= 5 GROUP BY ALL) SELECT qid, actual, label AS predicted FROM v QUALIFY row_number() OVER (PARTITION BY qid ORDER BY votes DESC, label) = 1")
def _(b):
    near = stats.nearest(b.table("embeddings"), "vec_id % 20 = 0", 5, 0.1)
    e = b.table("embeddings")
    votes = near.join(e.select("vec_id", "label"), "vec_id").groupBy("qid", "label").agg(F.count(F.lit(1)).alias("votes"))
    best = S.top(votes, ["votes DESC", "label"], 1, "nth", ["qid"])
    return best.join(e.select(F.col("vec_id").alias("qid"), F.col("label").alias("actual")), "qid").select("qid", "actual", F.col("label").alias("predicted"))


_NESTED = """concat('{"kind": "', event_type, '", "blank": [" ", ""], "n": 3, "inner": {"again": ["', event_type, '", {"user": "u', user_id, '"}]}}')"""


_SQ = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


@query("o179_nearest_centroid", f"WITH x AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings), u AS (SELECT vec_id, label, unnest(e) AS v, generate_subscripts(e, 1) AS i FROM x), m AS (SELECT label, i, avg(v) AS v FROM u GROUP BY label, i), c AS (SELECT label, list(v ORDER BY i) AS c FROM m GROUP BY label), d AS (SELECT vec_id, x.label AS actual, c.label, round(sqrt({_SQ.format(a='e', b='c')}), 6) AS dist FROM x, c) SELECT vec_id, actual, label AS predicted, dist FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, label) = 1")
def _(b):
    return stats.nearest_centroid(b.table("embeddings"))


@query("o08_json_leaf_text", "SELECT event_id, 'props' AS source, props AS leaf_text FROM events UNION ALL SELECT event_id, 'nested', concat(event_type, ' ', event_type, ' u', user_id) FROM events UNION ALL SELECT event_id, 'no json', concat('{', event_type) FROM events")
def _(b):
    """props holds no text leaf, so the raw value stands; of nested values the leaves, not the keys; what isn't JSON stays."""
    e = b.table("events")
    of = lambda name, x: e.select("event_id", F.lit(name).alias("source"), F.expr(x).alias("props"))
    rows = of("props", "props").unionByName(of("nested", _NESTED)).unionByName(of("no json", "concat('{', event_type)"))
    return stats.json_leaves(rows, "props")


@query("o08_json_leaf_rows", "SELECT event_id, '$.kind' AS path, 0 AS nth, event_type AS leaf FROM events UNION ALL SELECT event_id, '$.inner.again[0]', 1, event_type FROM events UNION ALL SELECT event_id, '$.inner.again[1].user', 2, concat('u', user_id) FROM events")
def _(b):
    """A row a leaf with its path, by a table function."""
    return extensions.json_leaf_rows(b.table("events").select("event_id", F.expr(_NESTED).alias("props")), "props")


@query("o179_document_embeddings")
def _(b):
    """Documents as means of word vectors learned on all of them, each with the class whose mean is nearest."""
    from termforge.operators import native_models

    found = stats.nearest_centroid(native_models.document_vectors(b.toks(), 20)[0])
    return found.withColumnRenamed("vec_id", "doc_id")


query("o136_vertical_concat", sql("SELECT 'post' AS part, term, tf AS n FROM post WHERE tf > 5 UNION ALL SELECT 'df' AS part, term, df AS n FROM dfs WHERE df > 20"))(
    lambda b: b.post.filter("tf > 5").select(F.lit("post").alias("part"), "term", F.col("tf").alias("n")).unionByName(M.document_frequency(b.post).filter("df > 20").select(F.lit("df").alias("part"), "term", F.col("df").alias("n"))))


_ORDER = ["frequency", "presence"]


@query("o199_best_in_fixed_order", sql("SELECT coalesce(o.place, 99) AS place, r.condition, r.feature_count, r.acc FROM (SELECT * FROM res WHERE mean_accuracy <> 'n/a' QUALIFY row_number() OVER (PARTITION BY condition ORDER BY acc DESC, CAST(feature_count AS BIGINT)) = 1) r LEFT JOIN (VALUES " + ", ".join(f"('{c}', {i})" for i, c in enumerate(_ORDER)) + ") o(condition, place) ON o.condition = r.condition", **_RESULTS))
def _(b):
    places = b.spark.createDataFrame([(c, i) for i, c in enumerate(_ORDER)], "condition string, place int")
    return S.best_rows(_results(b), ["condition"]).join(F.broadcast(places), "condition", "left").select(F.coalesce("place", F.lit(99)).alias("place"), "condition", "feature_count", "acc")




@query("o202_selected_terms_by_fold", sql("SELECT fold, term, s, CAST(row_number() OVER (PARTITION BY fold ORDER BY s DESC, term) AS INTEGER) AS selection_rank FROM train QUALIFY selection_rank <= 25", **_FOLD_TERMS))
def _(b):
    # training counts of a fold are the totals less the fold's own: one pass for all folds
    folds = splits.stratified(b.corpus.select("doc_id", "label"), 5)
    sizes = folds.groupBy("fold").agg(F.count_if(F.col("label") == 1).alias("k1"), F.count_if(F.col("label") == 0).alias("k0"))
    own = b.post.join(folds.select("doc_id", "fold"), "doc_id").groupBy("fold", "term").agg(F.count_if(F.col("label") == 1).alias("c1"), F.count_if(F.col("label") == 0).alias("c0"))
    totals = own.groupBy("term").agg(F.sum("c1").alias("df1"), F.sum("c0").alias("df0")).crossJoin(F.broadcast(b.sizes)).crossJoin(F.broadcast(sizes))
    rows = totals.join(own, ["fold", "term"], "left")
    share = lambda k: (F.col(f"df{k}") - F.coalesce(f"c{k}", F.lit(0))) / (F.col(f"n{k}") - F.col(f"k{k}"))
    return S.top(rows.select("fold", "term", r9(F.abs(share(1) - share(0))).alias("s")), ["s DESC", "term"], 25, "selection_rank", ["fold"])


