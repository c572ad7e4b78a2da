"""Sources, text functions and matrices (O-02 .. O-63)."""

from __future__ import annotations

from pyspark.sql import functions as F

from termforge.functions import text as T
from termforge.operators import corpus as C
from termforge.operators import matrix as M
from termforge.operators.corpus import r9
from termforge.plans.base import Base
from termforge.plans.sql import CTES, normalised, sql
from termforge.plans.sql import r9 as q9

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Base(spark, sf_dir))
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


_NAMES = "SELECT item_id, 'd' || CAST(item_id AS VARCHAR) || CASE item_id % 4 WHEN 0 THEN '_text_cleaned.txt' WHEN 1 THEN '_ocr_text_cleaned.txt' WHEN 2 THEN '_cleaned.txt' ELSE '.pdf' END AS name FROM benchmark"


@query("o04_display_name", f"SELECT item_id, name, CASE WHEN item_id % 4 = 1 THEN 'd' || CAST(item_id AS VARCHAR) || '_ocr.pdf' ELSE 'd' || CAST(item_id AS VARCHAR) || '.pdf' END AS shown FROM ({_NAMES})")
def _(b):
    ends = F.element_at(F.array(*map(F.lit, ["_text_cleaned.txt", "_ocr_text_cleaned.txt", "_cleaned.txt", ".pdf"])), (F.col("item_id") % 4 + 1).cast("int"))
    rows = b.table("benchmark").select("item_id", F.concat(F.lit("d"), F.col("item_id").cast("string"), ends).alias("name"))
    return rows.select("item_id", "name", T.display_name(F.col("name")).alias("shown"))


@query("o06_union_corpora", f"SELECT item_id AS doc_id, 1 AS label, {normalised('text')} AS text FROM benchmark UNION ALL SELECT conv_id * 1000 + turn AS doc_id, 0 AS label, {normalised('text')} AS text FROM conversations")
def _(b):
    one = b.table("benchmark").select(F.col("item_id").alias("doc_id"), T.normalize_text(F.col("text")).alias("text"))
    zero = b.table("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), T.normalize_text(F.col("text")).alias("text"))
    return C.union_corpora(one, zero)


@query("o07_label_map", "SELECT conv_id, turn, CASE lower(trim(role)) WHEN 'user' THEN 1 ELSE 0 END AS label FROM conversations WHERE role IS NOT NULL")
def _(b):
    rows = b.table("conversations").select("conv_id", "turn", "role")
    return C.map_labels(rows, "role", {"user": 1, "assistant": 0, "system": 0, "tool": 0}).drop("role")


@query("o17_multi_split", "SELECT 'bench' AS source_split, 'bench | ' || CAST(item_id AS VARCHAR) AS document_name, length(text) AS chars FROM benchmark UNION ALL SELECT 'conv' AS source_split, 'conv | ' || CAST(conv_id AS VARCHAR) || ' | ' || CAST(turn AS VARCHAR) AS document_name, length(text) AS chars FROM conversations")
def _(b):
    one = b.table("benchmark").select(F.lit("bench").alias("source_split"), F.concat_ws(" | ", F.lit("bench"), "item_id").alias("document_name"), F.length("text").cast("long").alias("chars"))
    two = b.table("conversations").select(F.lit("conv").alias("source_split"), F.concat_ws(" | ", F.lit("conv"), "conv_id", "turn").alias("document_name"), F.length("text").cast("long").alias("chars"))
    return one.unionByName(two, allowMissingColumns=True)


@query("o20_normalize_text", f"SELECT doc_id, {normalised('text')} AS text FROM documents")
def _(b):
    return b.table("documents").select("doc_id", T.normalize_text(F.col("text")).alias("text"))


@query("o20_normalize_text_digits", r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(text, '[-‐‑‒–—―]+', ' ', 'g'), '%', ' percent '), '[\r\n]+', ' ', 'g'), '[^a-zA-Z0-9\s]', '', 'g'), '\s+', ' ', 'g')) AS text FROM documents")
def _(b):
    return b.table("documents").select("doc_id", T.normalize_text(F.col("text"), True, "word").alias("text"))


@query("o21_strip_short_words", r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '[^a-zA-Z\s]', '', 'g'), '\b\w{1}\b', '', 'g'), '\s+', ' ', 'g')) AS text FROM documents")
def _(b):
    return b.table("documents").select("doc_id", T.strip_short_words(F.col("text")).alias("text"))


@query("o22_tokenize", sql("SELECT doc_id, array_to_string(list_filter(string_split(lower(text), ' '), lambda x: length(x) BETWEEN 2 AND 15), ' ') AS toks FROM corpus"))
def _(b):
    return b.corpus.select("doc_id", F.array_join(T.tokenize(F.col("text")), " ").alias("toks"))


@query("o23_stop_words", sql("SELECT doc_id, array_to_string(toks, ' ') AS toks, len(toks) AS n FROM toks"))
def _(b):
    return b.toks().select("doc_id", F.array_join("toks", " ").alias("toks"), F.size("toks").cast("long").alias("n"))


_OTHER = ["the", "of", "and", "ones", "whose", "upon"]


_SIDES = " UNION ALL ".join([f"SELECT '{w}' AS word, 'first' AS side" for w in sorted(set(T.STOP_WORDS) - set(_OTHER))] + [f"SELECT '{w}' AS word, 'second' AS side" for w in sorted(set(_OTHER) - set(T.STOP_WORDS))])


@query("o24_stop_word_lists", sql(f"SELECT s.word, side, count(r.doc_id) AS documents, CAST(coalesce(sum(r.n), 0) AS BIGINT) AS places FROM ({_SIDES}) s LEFT JOIN (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS word FROM corpus) GROUP BY doc_id, word) r ON r.word = s.word GROUP BY s.word, side"))
def _(b):
    """The words that only one of two stop lists holds, and how often the corpus has them: what exchanging the lists would do."""
    own = b.spark.createDataFrame([(w, side) for side, words, other in (("first", T.STOP_WORDS, _OTHER), ("second", _OTHER, T.STOP_WORDS)) for w in sorted(set(words) - set(other))], "word string, side string")
    found = b.corpus.select("doc_id", F.explode(F.split(F.lower("text"), " ")).alias("word")).join(F.broadcast(own.select("word")), "word", "left_semi").groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    return own.join(found, "word", "left").groupBy("word", "side").agg(F.count("doc_id").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("places"))


@query("o25_stem")
def _(b):
    return C.stemmed(b.post).groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))


# The tables hold no Japanese: some letters become kanji, katakana, hiragana and wide digits, the same on both sides.
_FROM, _TO = "aeioutnshrlcdmy", "アのカ本日東ーぁン語3年々ヵ２"


@query("o26_japanese_tokens", f"SELECT item_id, array_to_string(list_filter(regexp_extract_all(regexp_replace(lower(translate(text, '{_FROM}', '{_TO}')), '{T.JAPANESE_NUMBER}', ' ', 'g'), '{T.JAPANESE_WORD}'), lambda x: length(x) >= 2 AND NOT regexp_full_match(x, '[ぁ-ん]+|[0-9]+') AND x NOT IN ({', '.join(repr(w) for w in T.JAPANESE_STOP_WORDS)})), ' ') AS toks FROM benchmark")
def _(b):
    return b.table("benchmark").select("item_id", F.array_join(T.japanese_tokens(F.translate("text", _FROM, _TO)), " ").alias("toks"))


_BI = "SELECT doc_id, label, unnest(list_transform(range(1, greatest(len(toks), 1)), lambda i: toks[i] || ' ' || toks[i + 1])) AS term FROM toks"


@query("o27_ngrams", sql(f"SELECT term, count(*) AS tf FROM ({_BI}) GROUP BY term"))
def _(b):
    return b.toks(2, 2).select(F.explode("toks").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("tf"))


@query("o28_phrase_count", "SELECT doc_id, CAST((length(text) - length(replace(lower(text), 'of the', ''))) / 6 AS BIGINT) AS n FROM documents")
def _(b):
    return b.table("documents").select("doc_id", T.phrase_count(F.col("text"), "of the").alias("n"))


@query("o29_contains_term", sql("SELECT doc_id, CASE WHEN contains(' ' || array_to_string(toks, ' ') || ' ', ' on the ') THEN 1 ELSE 0 END AS has FROM (SELECT doc_id, string_split(lower(text), ' ') AS toks FROM corpus)"))
def _(b):
    return b.corpus.select("doc_id", T.contains_term(F.split(F.lower("text"), " "), "on the").alias("has"))


_RAW = "concat_ws('-', source, lang)"


@query("o30_normalize_terms", f"SELECT term, min(doc_id) AS first_place FROM (SELECT doc_id, lower({normalised(_RAW)}) AS term FROM documents) WHERE term <> '' GROUP BY term")
def _(b):
    """Terms as users give them, here each document's source and language, through the document pipeline; empty ones drop out, the first of equal ones stays."""
    given = b.table("documents").select("doc_id", F.lower(T.normalize_text(F.concat_ws("-", "source", "lang"))).alias("term"))
    return given.filter("term <> ''").groupBy("term").agg(F.min("doc_id").alias("first_place"))


@query("o31_word_count", sql("SELECT doc_id, label, words FROM wc"))
def _(b):
    return b.corpus.select("doc_id", "label", T.word_count(F.col("text")).alias("words"))


@query("o32_find_document", "SELECT doc_id, name FROM (SELECT doc_id, source || '-' || CAST(doc_id AS VARCHAR) AS name FROM documents) WHERE doc_id = 42")
def _(b):
    named = b.table("documents").select("doc_id", F.concat_ws("-", "source", "doc_id").alias("name"))
    hit = named.filter((F.lower("name") == "src2-42") | (F.col("doc_id") == 42))
    count = hit.agg(F.count(F.lit(1)).alias("c"))
    return hit.crossJoin(F.broadcast(count)).filter(F.when(F.col("c") == 1, True).otherwise(F.raise_error(F.lit("no unique document")).cast("boolean"))).drop("c")


@query("o40_term_frequency", sql("SELECT doc_id, term, tf FROM post"))
def _(b):
    return b.post.select("doc_id", "term", "tf")


@query("o41_document_frequency", sql("SELECT term, df, df1, df0 FROM dfs"))
def _(b):
    return M.document_frequency(b.post)


@query("o42_min_df", sql("SELECT term, df FROM dfs, sizes WHERE df / n > 0.02"))
def _(b):
    return M.keep_frequent(b.post, b.sizes, 0.02, strict=True).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _values(cte: str, **extra: str) -> str:
    return sql(f"SELECT doc_id, term, {q9('value')} AS value FROM {cte}", **extra)


def _shown(values):
    return values.select("doc_id", "term", r9(F.col("value")).alias("value"))


@query("o43_tfidf", _values("weights"))
def _(b):
    return _shown(b.weights)


_TRAIN = {
    "trainpost": "SELECT p.* FROM post p JOIN folds f USING (doc_id) WHERE fold <> 0",
    "testpost": "SELECT p.* FROM post p JOIN folds f USING (doc_id) WHERE fold = 0",
    "trainsize": "SELECT count(*) AS m FROM folds WHERE fold <> 0",
    "trainidf": "SELECT term, ln((1 + m) / (1 + count(*))) + 1 AS idf FROM trainpost, trainsize GROUP BY term, m",
    "testraw": "SELECT doc_id, term, tf * idf AS value FROM testpost JOIN trainidf USING (term)",
    "testw": "SELECT doc_id, term, value / sqrt(sum(value * value) OVER (PARTITION BY doc_id)) AS value FROM testraw",
}


def split(b, fold: int = 0):
    """(training postings, test postings, training size)."""
    from termforge.operators import splits

    folds = splits.stratified(b.corpus.select("doc_id", "label"), 5)
    train = folds.filter(F.col("fold") != fold)
    return b.post.join(train.select("doc_id"), "doc_id", "left_semi"), b.post.join(folds.filter(F.col("fold") == fold).select("doc_id"), "doc_id", "left_semi"), train.agg(F.count(F.lit(1)).alias("n"))


@query("o44_train_vocabulary", _values("testw", **_TRAIN))
def _(b):
    train, test, n = split(b)
    return _shown(M.tfidf(test, M.idf(train, n)))


@query("o45_relative_frequency", _values("rel"))
def _(b):
    return _shown(M.relative(b.post, b.lens))


@query("o46_log_normalised", _values("lognorm"))
def _(b):
    return _shown(M.log_normalised(b.post, b.lens))


@query("o47_log_numerator", sql(f"SELECT doc_id, term, {q9('1 + ln(tf)')} AS value FROM post"))
def _(b):
    return _shown(M.log_numerator(b.post))


@query("o48_row_l2_full", _values("tfl2"))
def _(b):
    return _shown(M.l2_rows(M.raw(b.post)))


@query("o49_row_l2_selected", sql(f"SELECT doc_id, term, {q9('tf / sqrt(sum(CAST(tf AS DOUBLE) * tf) OVER (PARTITION BY doc_id))')} AS value FROM post WHERE term IN (SELECT term FROM top30)"))
def _(b):
    return _shown(M.l2_rows(M.select_terms(M.raw(b.post), b.top(30))))


_MM = {
    "relsel": "SELECT r.doc_id, r.term, r.value, f.fold FROM rel r JOIN folds f USING (doc_id) WHERE term IN (SELECT term FROM top30)",
    "trainn": "SELECT count(*) AS m FROM folds WHERE fold <> 0",
    "ranges": "SELECT term, CASE WHEN count(*) < m THEN least(min(value), 0.0) ELSE min(value) END AS low, CASE WHEN count(*) < m THEN greatest(max(value), 0.0) ELSE max(value) END AS high FROM relsel, trainn WHERE fold <> 0 GROUP BY term, m",
}


@query("o50_min_max_train", sql(f"SELECT doc_id, term, {q9('CASE WHEN high > low THEN greatest(0.0, least(1.0, (value - low) / (high - low))) ELSE 0.0 END')} AS value FROM relsel JOIN ranges USING (term)", **_MM))
def _(b):
    from termforge.operators import splits

    values = M.select_terms(M.relative(b.post, b.lens), b.top(30))
    train = splits.stratified(b.corpus.select("doc_id", "label"), 5).filter("fold <> 0")
    ranges = M.column_range(values.join(train.select("doc_id"), "doc_id", "left_semi"), train.agg(F.count(F.lit(1)).alias("n")))
    return _shown(M.min_max(values, ranges))


_GRID = {"grid": "SELECT c.doc_id, c.label, t.term, CAST(coalesce(p.tf, 0) AS DOUBLE) AS value FROM corpus c CROSS JOIN (SELECT term FROM top30) t LEFT JOIN post p ON p.doc_id = c.doc_id AND p.term = t.term"}


def _grid(b):
    return M.dense(M.raw(b.post), b.corpus, b.top(30))


@query("o51_row_min_max", sql(f"SELECT doc_id, term, {q9('CASE WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) ELSE 0.0 END')} AS value FROM grid WINDOW w AS (PARTITION BY doc_id)", **_GRID))
def _(b):
    return _shown(M.row_min_max(_grid(b)))


@query("o52_column_min_max", sql(f"SELECT doc_id, term, {q9('CASE WHEN high > low THEN (value - low) / (high - low) ELSE 0.0 END')} AS value FROM (SELECT doc_id, term, value, min(value) OVER (PARTITION BY term) AS low, max(value) OVER (PARTITION BY term) AS high FROM grid)", **_GRID))
def _(b):
    grid = _grid(b)
    return _shown(M.min_max(grid, M.column_range(grid, b.sizes), clip=False))


@query("o53_standard_scale", sql(f"SELECT doc_id, {q9('(words - m) / s')} AS z FROM wc, (SELECT avg(words) AS m, stddev_pop(words) AS s FROM wc)"))
def _(b):
    own = b.corpus.select("doc_id", T.word_count(F.col("text")).alias("words"))
    return own.crossJoin(F.broadcast(own.agg(F.avg("words").alias("m"), F.stddev_pop("words").alias("s")))).select("doc_id", r9((F.col("words") - F.col("m")) / F.col("s")).alias("z"))


_WIDE = ["ing", "was", "tion", "thor"]


def _wide(unit: str, kind: str) -> str:
    return sql("SELECT c.doc_id, c.label, " + ", ".join(f"CAST(coalesce(max(CASE WHEN term = '{w}' THEN {unit} END), 0) AS {kind}) AS {w}_v" for w in _WIDE) + " FROM corpus c LEFT JOIN post p USING (doc_id) GROUP BY c.doc_id, c.label")


def _renamed(wide):
    return wide.select("doc_id", "label", *[F.col(w).alias(f"{w}_v") for w in _WIDE])


@query("o54_binary_frame", _wide("1", "BIGINT"))
def _(b):
    return _renamed(M.pivot_terms(M.raw(b.post), b.corpus, _WIDE, binary=True))


@query("o55_count_frame", _wide("tf", "BIGINT"))
def _(b):
    return _renamed(M.pivot_terms(b.post.withColumnRenamed("tf", "value"), b.corpus, _WIDE))


@query("o56_source_features", sql(f"SELECT doc_id, term || '__df' AS feature, 1.0 AS value FROM post WHERE term IN (SELECT term FROM top30 WHERE selection_rank <= 10) UNION ALL SELECT doc_id, term || '__tfidf' AS feature, {q9('value')} AS value FROM weights WHERE term IN (SELECT term FROM top30 WHERE selection_rank <= 10) UNION ALL SELECT doc_id, term || '__tf' AS feature, {q9('value')} AS value FROM rel WHERE term IN (SELECT term FROM top30 WHERE selection_rank <= 10)"))
def _(b):
    best = b.top(10).select("term")
    name = lambda s: F.concat("term", F.lit(s)).alias("feature")
    df = M.select_terms(b.post, best).select("doc_id", name("__df"), F.lit(1.0).alias("value"))
    idf = M.select_terms(b.weights, best).select("doc_id", name("__tfidf"), r9(F.col("value")).alias("value"))
    tf = M.select_terms(M.relative(b.post, b.lens), best).select("doc_id", name("__tf"), r9(F.col("value")).alias("value"))
    return df.unionByName(idf).unionByName(tf)


@query("o57_count_features", sql("SELECT doc_id, selection_rank, tf, 1 AS present FROM post JOIN top30 USING (term)"))
def _(b):
    return b.post.join(F.broadcast(b.top(30)), "term").select("doc_id", "selection_rank", "tf", F.lit(1).alias("present"))


@query("o58_word_count_feature", sql(f"SELECT doc_id, {q9('(ln(1 + words) - lo) / (hi - lo)')} AS doc_word_count_mm FROM (SELECT doc_id, words, fold FROM wc JOIN folds USING (doc_id)), (SELECT min(ln(1 + words)) AS lo, max(ln(1 + words)) AS hi FROM wc JOIN folds USING (doc_id) WHERE fold <> 0)"))
def _(b):
    from termforge.operators import splits

    own = b.corpus.select("doc_id", "label", F.log1p(T.word_count(F.col("text"))).alias("v"))
    train = splits.stratified(b.corpus.select("doc_id", "label"), 5).filter("fold <> 0")
    fitted = own.join(train.select("doc_id"), "doc_id", "left_semi").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return own.crossJoin(F.broadcast(fitted)).select("doc_id", r9((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("doc_word_count_mm"))


@query("o59_prefix_slice", sql("SELECT k, count(*) AS cells FROM (SELECT selection_rank FROM post JOIN top30 USING (term)), (VALUES (10), (20), (30)) t(k) WHERE selection_rank <= k GROUP BY k"))
def _(b):
    ranked = b.post.join(F.broadcast(b.top(30)), "term")
    return ranked.select(F.explode(F.array(*map(F.lit, (10, 20, 30)))).alias("k"), "selection_rank").filter("selection_rank <= k").groupBy("k").agg(F.count(F.lit(1)).alias("cells"))


@query("o60_full_corpus_tfidf", sql(f"SELECT term, {q9('sum(value)')} AS total FROM weights GROUP BY term"))
def _(b):
    return b.weights.groupBy("term").agg(r9(F.sum("value")).alias("total"))


@query("o61_vocabulary", sql("SELECT row_number() OVER (ORDER BY term) - 1 AS feature_index, term FROM dfs"))
def _(b):
    return M.vocabulary(b.post)


@query("o62_relative_min_max", sql(f"SELECT doc_id, term, {q9('CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0.0 END')} AS value FROM rel JOIN (SELECT term, CASE WHEN count(*) < max(n) THEN 0.0 ELSE min(value) END AS lo, max(value) AS hi FROM rel, sizes GROUP BY term) USING (term) WHERE term IN (SELECT term FROM top30)"))
def _(b):
    values = M.select_terms(M.relative(b.post, b.lens), b.top(30))
    return _shown(M.min_max(values, M.column_range(values, b.sizes)))


@query("o63_vocabulary_variants", sql("SELECT df_filtered, count(*) AS terms FROM (SELECT df / n > 0.02 AS df_filtered FROM dfs, sizes) GROUP BY df_filtered"))
def _(b):
    return M.document_frequency(b.post).crossJoin(F.broadcast(b.sizes)).groupBy((F.col("df") / F.col("n") > 0.02).alias("df_filtered")).agg(F.count(F.lit(1)).alias("terms"))


@query("o15_corpus_facade", sql("SELECT label, count(*) AS cells, CAST(sum(tf) AS BIGINT) AS total FROM (SELECT label, term, count(*) AS tf FROM (SELECT doc_id, label, term FROM (SELECT doc_id, label, unnest(toks) AS term FROM toks) UNION ALL SELECT doc_id, label, term FROM bigrams) GROUP BY doc_id, label, term) GROUP BY label", bigrams=_BI))
def _(b):
    return C.postings(b.toks(1, 2)).groupBy("label").agg(F.count(F.lit(1)).alias("cells"), F.sum("tf").alias("total"))
