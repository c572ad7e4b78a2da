"""Shared parts of the SQL that states the same rows as a query."""

from __future__ import annotations

import re

from termforge.functions.text import STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_NORM = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, '[-‐‑‒–—―]+', ' ', 'g'), '[\r\n]+', ' ', 'g'), '[^a-zA-Z\s]', '', 'g'), '\s+', ' ', 'g'))"""


def r9(x: str) -> str:
    return f"(round({x}, 9) + 0.0)"


def normalised(column: str) -> str:
    return _NORM.format(t=column)


def difference(source: str, metric: str, mean: bool) -> str:
    """The body of a metric table over CTE `source`(label, term, value)."""
    a, b = ("s1 / n1", "s0 / n0") if mean else ("s1", "s0")
    return f"""SELECT '{metric}' AS metric_id, term, {r9('v1')} AS label1_value, {r9('v0')} AS label0_value, {r9('v1 - v0')} AS difference,
 {r9('abs(v1 - v0)')} AS absolute_difference, CASE WHEN {r9('v1 - v0')} >= 0 THEN 1 ELSE 0 END AS larger_label,
 CASE WHEN {r9('v1 - v0')} > 0 THEN 'label1' WHEN {r9('v1 - v0')} < 0 THEN 'label0' ELSE 'neutral' END AS dominant_label
 FROM (SELECT term, {a} AS v1, {b} AS v0 FROM (SELECT term, sum(CASE WHEN label = 1 THEN value ELSE 0.0 END) AS s1, sum(CASE WHEN label = 0 THEN value ELSE 0.0 END) AS s0
 FROM (SELECT label, term, CAST(value AS DOUBLE) AS value FROM {source}) GROUP BY term), sizes)"""


CTES = {
    "corpus": f"SELECT d.doc_id, concat_ws('-', d.source, CAST(d.doc_id AS VARCHAR)) AS doc_name, CAST(l.quality AS INTEGER) AS label, {normalised('d.text')} AS text FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL",
    "rawcorpus": "SELECT d.doc_id, CAST(l.quality AS INTEGER) AS label, d.text FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL",
    "toks": f"SELECT doc_id, label, list_filter(string_split(lower(text), ' '), lambda x: length(x) BETWEEN 2 AND 15 AND x NOT IN ({_STOP})) AS toks FROM corpus",
    "post": "SELECT doc_id, label, term, count(*) AS tf FROM (SELECT doc_id, label, unnest(toks) AS term FROM toks) GROUP BY doc_id, label, term",
    "lens": "SELECT doc_id, label, CAST(len(toks) AS BIGINT) AS len_tokens FROM toks",
    "sizes": "SELECT count(*) FILTER (WHERE label = 1) AS n1, count(*) FILTER (WHERE label = 0) AS n0, count(*) AS n FROM corpus",
    "dfs": "SELECT term, count(*) AS df, count(*) FILTER (WHERE label = 1) AS df1, count(*) FILTER (WHERE label = 0) AS df0 FROM post GROUP BY term",
    "idfs": "SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM dfs, sizes",
    "unscaled": "SELECT doc_id, label, term, tf * idf AS value FROM post JOIN idfs USING (term)",
    "weights": "SELECT doc_id, label, term, value / sqrt(sum(value * value) OVER (PARTITION BY doc_id)) AS value FROM unscaled",
    "rel": "SELECT doc_id, post.label, term, CASE WHEN len_tokens > 0 THEN tf / len_tokens ELSE 0.0 END AS value FROM post JOIN lens USING (doc_id)",
    "lognorm": "SELECT doc_id, post.label, term, (1 + ln(tf)) / (1 + ln(len_tokens)) AS value FROM post JOIN lens USING (doc_id)",
    "tfl2": "SELECT doc_id, label, term, tf / sqrt(sum(CAST(tf AS DOUBLE) * tf) OVER (PARTITION BY doc_id)) AS value FROM post",
    "logl2": "SELECT doc_id, label, term, (1 + ln(tf)) / sqrt(sum((1 + ln(tf)) * (1 + ln(tf))) OVER (PARTITION BY doc_id)) AS value FROM post",
    "scores": f"""SELECT term, df1 AS label1_doc_count, df0 AS label0_doc_count, n1 AS label1_total_docs, n0 AS label0_total_docs, s AS label1_score, 0.0 - s AS label0_score, abs(s) AS abs_score,
 CASE WHEN s > 0 THEN 'label1' WHEN s < 0 THEN 'label0' ELSE 'neutral' END AS dominant_label, CASE WHEN s > 0 THEN 'label1_score' WHEN s < 0 THEN 'label0_score' ELSE '' END AS selected_score_source,
 abs(s) AS selected_score, df1 - df0 AS doc_count_diff_label1_minus_label0, df0 - df1 AS doc_count_diff_label0_minus_label1
 FROM (SELECT *, {r9('df1 / n1 - df0 / n0')} AS s FROM dfs, sizes)""",
    "ranked": "SELECT *, CAST(row_number() OVER (ORDER BY abs_score DESC, selected_score DESC, label1_doc_count DESC, label0_doc_count DESC, term) AS INTEGER) AS selection_rank FROM scores",
    "top30": "SELECT term, selection_rank FROM ranked WHERE selection_rank <= 30",
    "folds": "SELECT doc_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY doc_id) - 1) % 5 AS INTEGER) AS fold FROM corpus",
    "margin": "SELECT doc_id, corpus.label, round(coalesce(sum(w), 0.0), 9) + 0.0 AS decision FROM corpus LEFT JOIN (SELECT doc_id, r.label1_score AS w FROM post JOIN ranked r ON post.term = r.term AND r.selection_rank <= 30) USING (doc_id) GROUP BY doc_id, corpus.label",
    "preds": "SELECT m.doc_id, m.label, f.fold, m.decision, CASE WHEN m.decision > 0 THEN 1 ELSE 0 END AS predicted FROM margin m JOIN folds f USING (doc_id)",
    "wc": r"SELECT doc_id, label, CASE WHEN trim(text) = '' THEN 0 ELSE CAST(len(string_split(trim(text), ' ')) AS INTEGER) END AS words FROM corpus",
}


def sql(body: str, **extra: str) -> str:
    """body with the CTEs it needs, directly or through others; extra ones come by name."""
    known = CTES | extra
    order: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if name not in order and re.search(rf"(?:\bFROM|\bJOIN|,)\s+{name}\b", text) and text is not known[name]:
                visit(known[name])
                if name not in order:
                    order.append(name)

    visit(body)
    return ("WITH " + ",\n".join(f"{n} AS ({known[n]})" for n in order) + "\n" if order else "") + body
