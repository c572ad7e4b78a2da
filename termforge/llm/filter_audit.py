"""How filters interact: what each removes under every order, from one count of failure masks.

A document's mask has a bit for each filter that it fails. Per part only the counts of the 2^k masks
matter. A subset-zeta transform turns them into the survivors of every filter subset S, the sum of the
counts of all masks within the complement of S, in k rounds of adding neighbours. What a step of an
order removes is the difference between the survivors of two neighbouring subsets, and likewise for
documents that a label marks. All orders and steps are look-ups then: the corpus is read once, however
many orders there are.

A text that equals that of a smaller doc_id fails `E`. Texts are compared by SHA-256. The least doc_id of
a text is a partial aggregate, and rows meet it by (digest, doc_id), so a text with any number of
copies is no hot key of a join.

Null texts are empty, a null part is the empty part. Rows without doc_id neither fail `E` nor make others
fail it, and have no labels. Repeated rows count as often as they stand there; a doc_id's own other
rows don't make it fail `E`. A doc_id with several label rows is marked if one of them marks it. Very
long texts are measured whole. Other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termforge.llm._store import drop, keep

FILTERS = "ABCDE"
EVERY = (1 << len(FILTERS)) - 1
COPY = 1 << FILTERS.index("E")
SPACE = r"[\x20\x09-\x0D]+"


def own_mask(body: Column) -> Column:
    """The bits of the filters that look at one text: A few words, B repeated words, C capitals, D symbols."""

    def bits(words: Column) -> Column:
        fails = (
            F.size(words) < 100,
            100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
            100 * F.regexp_count(body, F.lit("[A-Z]")) > 10 * F.length(body),
            F.regexp_like(body, F.lit(r"[#$%&*|]")),
        )
        return sum((F.when(x, F.lit(1 << k)).otherwise(F.lit(0)) for k, x in enumerate(fails)), F.lit(0))

    return F.get(F.transform(F.array(F.array_remove(F.split(body, SPACE), "")), bits), F.lit(0))


def measured(docs: DataFrame, part: str = "lang") -> DataFrame:
    """doc_id, part, own (bits of the filters on one text) and the text's digest: narrow rows, written once."""
    rows = docs.select("doc_id", F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("body"))
    return keep(rows.select("doc_id", "part", own_mask(F.col("body")).alias("own"), F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("digest")))


def masks(rows: DataFrame) -> DataFrame:
    """doc_id, part and mask (filter k of FILTERS is bit k) of each of the measured rows."""
    named = rows.filter(F.col("doc_id").isNotNull())
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.when(F.col("first"), F.lit(0)).otherwise(F.lit(COPY))
    judged = named.join(first, ["digest", "doc_id"], "left").select("doc_id", "part", (F.col("own") + copy).alias("mask"))
    return judged.unionByName(rows.filter(F.col("doc_id").isNull()).select("doc_id", "part", F.col("own").alias("mask")))


def counts(marked: DataFrame, labels: dict[str, Column]) -> DataFrame:
    """part, and for `found` and each label an array with the count of every mask; partial aggregates."""
    by_mask = marked.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("found"), *[F.count_if(c).alias(n) for n, c in labels.items()])
    of = lambda n: F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(n))), F.lit(0)) for m in range(EVERY + 1)])
    return by_mask.groupBy("part").agg(*[of(n).alias(n) for n in ("found", *labels)])


def zeta(found: Column) -> Column:
    """Entry T of the result is the sum of all entries that are subsets of T: a round of neighbours for each filter."""

    def with_neighbours(bit: int) -> Callable[[Column], Column]:
        return lambda xs: F.transform(xs, lambda x, t: F.when(t.bitwiseAND(F.lit(bit)) != 0, x + F.get(xs, t - bit)).otherwise(x))

    for k in range(len(FILTERS)):
        found = F.get(F.transform(F.array(found), with_neighbours(1 << k)), F.lit(0))
    return found


def steps() -> Column:
    """Every step of every order, a literal array: filter_order, step, f (filter's number), bit, before and after (subsets)."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            after = before | 1 << f
            named = {"filter_order": "".join(FILTERS[k] for k in order), "step": step, "f": f, "bit": 1 << f, "before": before, "after": after}
            rows.append(F.struct(*[F.lit(v).alias(n) for n, v in named.items()]))
            before = after
    return F.array(*rows)


def audit(docs: DataFrame, marks: DataFrame | None = None, part: str = "lang") -> DataFrame:
    """A row per part, order and step: part, filter_order, step, kept, removed, redundant, unique_fails, a <mark>_lost
    for each column of marks but doc_id, shapley.

    marks: doc_id and boolean columns, such as a label's. shapley is what the step's filter removes, summed over all orders.
    """
    names = [] if marks is None else [c for c in marks.columns if c != "doc_id"]
    rows = measured(docs, part)
    marked = masks(rows)
    if names:
        own = marks.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.bool_or(F.coalesce(F.col(n), F.lit(False))).alias(n) for n in names])
        marked = marked.join(own, "doc_id", "left")
    table = keep(counts(marked, {n: F.coalesce(F.col(n), F.lit(False)) for n in names}))
    drop(docs.sparkSession, rows)
    within = table.select("part", F.col("found").alias("by_mask"), *[zeta(F.col(n)).alias(n) for n in ("found", *names)])
    survivors = lambda n, subset: F.get(F.col(n), F.lit(EVERY) - subset)
    others = lambda f: [s for s in range(EVERY + 1) if not s >> f & 1]
    orders = lambda s: factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count())  # noqa: E731  that reach the filter after just these
    total = F.array(*[sum((F.lit(orders(s)) * (survivors("found", F.lit(s)) - survivors("found", F.lit(s | 1 << f))) for s in others(f)), F.lit(0)) for f in range(len(FILTERS))])
    at = within.select("*", total.alias("total")).select("*", F.explode(steps()).alias("s"))
    lost = lambda n: survivors(n, F.col("s.before")) - survivors(n, F.col("s.after"))
    fails = survivors("found", F.lit(0)) - survivors("found", F.col("s.bit"))
    return at.select(
        "part",
        "s.filter_order",
        "s.step",
        survivors("found", F.col("s.after")).alias("kept"),
        lost("found").alias("removed"),
        (fails - lost("found")).alias("redundant"),
        F.get("by_mask", F.col("s.bit")).alias("unique_fails"),
        *[lost(n).alias(f"{n}_lost") for n in names],
        F.get("total", F.col("s.f")).alias("shapley"),
    )
