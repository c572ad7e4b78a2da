"""Quality rules as a short-circuit cascade of native column expressions.

A rule is a boolean expression over the text and its measures. On a bounded sample the cascade
measures what each rule costs, with the measures it needs, and how often it rejects; rules are then
tried in the order of rejections per cost and the first that rejects ends the evaluation (CASE WHEN
is lazy). keep_good computes a measure only inside the rule that reads it, so what an early rule
rejects skips the rest; quality returns all measures and so computes them for every row. The order
changes the cost and rejected_by only: the verdict is the disjunction of all rules.

Nulls and empty texts have no words, all measures 0 and are rejected by the base rules. Very long
texts are measured whole, in linearithmic time. Extra columns are ignored (keep_good returns them),
repeated rows give repeated results, ties can't occur, an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


@dataclass
class Measures:
    """What a rule may read; columns of measures() or, in a lazy cascade, the expressions behind them."""

    body: Column
    n_words: Column
    word_chars: Column
    n_symbols: Column
    n_dup_lines: Column
    n_repeat_words: Column


Rule = tuple[str, Callable[[Measures], Column]]


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, whatever the optimiser inlines."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_window_words(tokens: Column, width: int = 3) -> Column:
    """Words that lie in a window of `width` words found at two or more places of the same text.

    Windows are hashed to 64 bits. Where no hash repeats the answer is 0; else the repeated hashes
    are sorted out, few ones by a scan and many ones by sorting hashes with their places, and the
    union of the repeated windows is summed over their places. Linearithmic in the text's length.
    """
    few = 12
    none = F.array().cast("array<int>")

    def hashes(w: Column) -> Column:
        last = F.size(w) - F.lit(width)
        at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(none)
        return F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))

    def twice(s: Column) -> Column:
        return F.array_distinct(F.filter(s, lambda x, j: x == F.get(s, j + 1)))

    def by_scan(h: Column, again: Column) -> Column:
        return F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(again, x), i).otherwise(F.lit(-1))), lambda i: i >= 0)

    def by_sort(h: Column) -> Column:
        def found(s: Column) -> Column:
            same = lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"])
            return F.sort_array(F.transform(F.filter(s, lambda x, j: F.coalesce(same(x, j), F.lit(False))), lambda x: x["i"]))

        return let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), found)

    def places(h: Column) -> Column:
        return let(let(F.sort_array(h), twice), lambda again: F.when(F.size(again) <= few, by_scan(h, again)).otherwise(by_sort(h)))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, j: F.least(F.lit(width), F.coalesce(F.get(p, j + 1) - x, F.lit(width))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(
        hashes(tokens),
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(places(h), covered)),
    )


def expressions(body: Column, tokens: Column) -> Measures:
    """The measures of a text (not null) and its words(), as expressions; all longs."""
    lines = F.filter(F.split(body, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    return Measures(
        body,
        F.size(tokens).cast("long"),
        F.length(F.array_join(tokens, "")).cast("long"),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("long"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        repeated_window_words(tokens).cast("long"),
    )


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, body (the text, null as empty) and the measures."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body")).withColumn("tokens", words(F.col("body")))
    found = expressions(F.col("body"), F.col("tokens"))
    return base.select("doc_id", "body", *[getattr(found, n).alias(n) for n in NAMES])


def measured() -> Measures:
    return Measures(F.col("body"), *map(F.col, NAMES))


#: The base rules: their disjunction is base_failed.
BASE: list[Rule] = [
    ("few_words", lambda m: m.n_words < 50),
    ("repeated_words", lambda m: 100 * m.n_repeat_words > 50 * m.n_words),
]


def default_rules() -> list[Rule]:
    """Each rule rejects where its expression is true."""
    return [
        ("symbols", lambda m: m.n_symbols > 0.25 * m.n_words),
        ("shouting", lambda m: F.regexp_count(m.body, F.lit(r"!")) > 0.3 * m.n_words),
        ("capitals", lambda m: F.regexp_count(m.body, F.lit(r"\p{Lu}")) > 0.6 * m.word_chars),
        ("word_length", lambda m: (m.word_chars < 2 * m.n_words) | (m.word_chars > 40 * m.n_words)),
        ("repeated_lines", lambda m: 2 * m.n_dup_lines > 1 + F.regexp_count(m.body, F.lit("\n"))),
    ]


#: Rules whose rejections per cost differ by less than this share count as alike and go by name.
ALIKE = 0.25


def costs(docs: DataFrame, rules: list[Rule], sample_rows: int = 500, longest: int = 20_000, passes: int = 6) -> dict[str, tuple[float, float]]:
    """Of each rule (seconds a row, rejected share), measured on at most `sample_rows` rows of at most `longest`
    characters that the scan yields first; a bound on the estimate only, since the order doesn't change any verdict.

    One job evaluates all rules on each text, one after another, with the clock read between them (a rule's
    time has the measures that it reads, not the cutting of words). The sample is passed over several
    times, the first of them before code is compiled; a text's time under a rule is the least of its passes.
    """
    rows = docs.select(F.coalesce("text", F.lit("")).alias("body")).filter(F.length("body") <= longest).limit(sample_rows).collect()
    if not rows or not rules:
        return {name: (0.0, 0.0) for name, _ in rules}
    sample = docs.sparkSession.createDataFrame([(k, r["body"]) for k, r in enumerate(rows)], "k int, body string").coalesce(1)
    again = sample.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(passes)))).sortWithinPartitions("again")
    clock = F.java_method(F.lit("java.lang.System"), F.lit("nanoTime")).cast("long")

    def timed(w: Column) -> Column:
        m = expressions(F.col("body"), w)
        return F.array(clock, *[x for _, rule in rules for x in (F.coalesce(rule(m), F.lit(False)).cast("long"), clock)])

    at = again.select("k", let(words(F.col("body")), timed).alias("t"))
    one = [F.min(F.get("t", F.lit(2 * i + 2)) - F.get("t", F.lit(2 * i))).alias(f"took{i}") for i in range(len(rules))]
    hits = [F.max(F.get("t", F.lit(2 * i + 1))).alias(f"hit{i}") for i in range(len(rules))]
    found = at.groupBy("k").agg(*one, *hits).agg(*[F.avg(f"{c}{i}").alias(f"{c}{i}") for i in range(len(rules)) for c in ("took", "hit")]).first()
    return {name: (found[f"took{i}"] / 1e9, found[f"hit{i}"]) for i, (name, _) in enumerate(rules)}


def order_rules(docs: DataFrame, rules: list[Rule], sample_rows: int = 500) -> list[tuple[str, float, float]]:
    """(rule, seconds a row, rejected share), best rejection per cost first; rules that are ALIKE within the noise of
    a measurement, such as those that reject nothing, go by name."""
    found = [(name, cost, share, share / max(cost, 1e-9)) for name, (cost, share) in costs(docs, rules, sample_rows).items()]
    out: list[tuple[str, float, float]] = []
    left = sorted(found, key=lambda x: (-x[3], x[0]))
    while left:
        own = [x for x in left if x[3] >= (1 - ALIKE) * left[0][3]]
        left = left[len(own) :]
        out += [x[:3] for x in sorted(own)]
    return out


def verdict(rules: list[Rule], order: list[str], m: Measures) -> Column:
    """Name of the first rule in `order` that rejects, else null; later rules aren't evaluated."""
    by_name = dict(rules)
    out = None
    for name in order:
        rejects = by_name[name](m)
        out = F.when(rejects, F.lit(name)) if out is None else out.when(rejects, F.lit(name))
    return F.lit(None).cast("string") if out is None else out


def quality(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = 500) -> DataFrame:
    """One row a document: doc_id, the measures, base_failed, kept, rejected_by (null if kept)."""
    rules = BASE + (default_rules() if rules is None else rules)
    order = [x[0] for x in order_rules(docs, rules, sample_rows)]
    m = measured()
    base = BASE[0][1](m) | BASE[1][1](m)
    judged = measures(docs).select("*", base.alias("base_failed"), verdict(rules, order, m).alias("by"))
    return judged.select("doc_id", *NAMES, "base_failed", F.col("by").isNull().alias("kept"), F.col("by").alias("rejected_by"))


def keep_good(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = 500) -> DataFrame:
    """The rows of docs (all their columns) that the cascade keeps; a filter, without a join.

    The words are cut once; every other measure is computed by the first rule that needs it.
    """
    rules = BASE + (default_rules() if rules is None else rules)
    order = [x[0] for x in order_rules(docs, rules, sample_rows)]
    body = F.coalesce("text", F.lit(""))
    rejected = let(words(body), lambda w: verdict(rules, order, expressions(body, w)))
    return docs.filter(rejected.isNull())
