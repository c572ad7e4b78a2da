"""Near duplicates by BagMinHash: multisets of word shingles, weighted Jaccard, classes of documents.

Signature. Each shingle of weight w (its count) carries Poisson processes over the dyadic weight
intervals [0,1), [1,2), [2,4), ...: an interval of length r has points at rate r, each with a place
in the interval and one of the signature's registers; points whose place is below w count. A
register keeps the least arrival, so two registers agree with probability weighted Jaccard.
Arrivals are drawn in rising order and a process stops when it has passed the document's largest
register.

Candidates. Registers are banded. Copies with one multiset are one node. A band's bucket is a star
around its leader L, the member with most bucket-mates over all bands: each member is compared
with L on the exact multisets (units: a shingle and which occurrence it is), and the difference to
L is kept. Links make components.

The rest. Members x, y of one star that L doesn't connect may still be similar. If y isn't similar
to L, then with D the difference to L, R the part that L has alone, A the part it lacks,
q = (1 - t) / (1 + t) for similarity t, and n the sizes,

    |x - y| <= q (n_x + n_y)   <=>   |D_x & D_y| >= (|D_x| + |D_y| - q (n_x + n_y)) / 2,

which is above ((1 + q) |R_x| + (1 - q) |A_x|) / 2 and at least (|D_y| - q (n_L + n_y)) / 2 > 0.
So x and y share units of their differences, and with the units in one order (rare in the star
first) they share one among the first |D| - bound + 1 of both. Only those are joined; a shared unit
at places i and j leaves room for 1 + min(k_x - i, k_y - j) shared ones, which must reach the bound
of the pair. What is left is compared exactly. Units that only members of one component have can't
link components and are left out. No pair of a star that is similar is lost, nothing is capped, and
members of a group that only its original connects aren't paired with each other.

Classes. Components come from least labels with pointer jumps; a class is named by its least doc_id.
The loss by design: pairs that share no band (nor a leader) are no candidates.

Texts of fewer than five words are one shingle, all their words; null and empty texts are each
their own class. Words are case-folded for A-Z. Texts are never cut: a very long one is one row of
8 bytes a word in the tables of units. Extra columns are ignored; repeated rows fall in one class;
rows of one doc_id with different texts are different members and each gets its own class_id; rows
without doc_id take part and may name a class null only if all its ids are null. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termforge.llm import _bytes as B
from termforge.llm._store import drop, keep

SHINGLE, SIMILARITY = 5, 0.8
REGISTERS, ROWS = 64, 4


def shingles(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, count) of each distinct shingle of a document; documents rise."""
    words, first = B.word_hashes(texts)
    hashes, docs = B.ngrams(words, first, width)
    size = np.diff(first)
    for n in range(1, width):  # short texts
        if (short := size == n).any():
            h, d = B.ngrams(words, first, n)
            mine = short[d]
            hashes, docs = np.concatenate((hashes, h[mine])), np.concatenate((docs, d[mine]))
    order = np.lexsort((hashes, docs))
    hashes, docs = hashes[order], docs[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    at = np.flatnonzero(new)
    return docs[at], hashes[at], np.diff(np.append(at, len(hashes)))


def signatures(n_docs: int, docs: np.ndarray, elements: np.ndarray, weights: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """BagMinHash registers, n_docs by registers; inf where a document has no element."""
    out = np.full(n_docs * registers, np.inf)
    levels = 1 + np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64)  # intervals that reach below the weight
    owner = np.repeat(np.arange(len(docs)), levels)
    level = np.arange(len(owner)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    rate = np.where(level == 0, 1.0, low)
    state = B.mix(elements[owner] + level.astype(np.uint64) * B.U(0xA0761D6478BD642F) + B.U(1))
    doc, weight, time = docs[owner], weights[owner].astype(float), np.zeros(len(owner))
    while len(doc):
        state = B.mix(state + B.U(0xE7037ED1A0B428DB))
        time = time - np.log(B.uniform(state)) / rate
        other = B.mix(state ^ B.U(0x8EBC6AF09C88C6E3))
        register = (other % B.U(registers)).astype(np.int64)
        place = low + rate * B.uniform(B.mix(other ^ B.U(0x589965CC75374CC3)))
        fits = place < weight
        np.minimum.at(out, doc[fits] * registers + register[fits], time[fits])
        most = out.reshape(n_docs, registers).max(1)
        alive = time < most[doc]
        state, time, doc, weight, low, rate = (x[alive] for x in (state, time, doc, weight, low, rate))
    return out.reshape(n_docs, registers)


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key a band, the band's number mixed in."""
    bits = signature.view(np.uint64)
    n = signature.shape[1] // rows
    out = np.zeros((len(signature), n), np.uint64)
    for k in range(rows):
        out = B.mix(out * B.U(0x9FB21C651E98DF25) + bits[:, k : n * rows : rows] + np.arange(n, dtype=np.uint64))
    return out


def _bag(n: int, docs: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One hash for the multiset of each document."""
    out = np.zeros(n, np.uint64)
    np.add.at(out, docs, B.mix(B.mix(hashes) + counts.astype(np.uint64)))
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in B.small_batches(batches, 1):
        n = batch.num_rows
        docs, hashes, counts = shingles(batch.column(1))
        keys = band_keys(signatures(n, docs, hashes, counts))
        bag = _bag(n, docs, hashes, counts)
        size = np.bincount(docs, counts, n).astype(np.int64)
        full = size > 0
        per = keys.shape[1]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.where(full, per, 0)))), pa.int32()), pa.array(keys[full].ravel().view(np.int64)))
        bags = pa.array(bag.view(np.int64), mask=~full)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), bags, lists], ["doc_id", "fp", "bag", "keys"])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bag, units): the multiset as distinct hashes of (shingle, occurrence)."""
    for batch in B.small_batches(batches, 0):
        n = batch.num_rows
        docs, hashes, counts = shingles(batch.column(0))
        owner = np.repeat(np.arange(len(docs)), counts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        units = B.mix(hashes[owner] + nth.astype(np.uint64) * B.U(0xC2B2AE3D27D4EB4F))
        ends = np.searchsorted(docs[owner], np.arange(n + 1))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(units.view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(_bag(n, docs, hashes, counts).view(np.int64)), lists], ["bag", "units"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of each node in edges (a, b); label is the component's least node."""
    spark = edges.sparkSession
    both = keep(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = keep(labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was")))
        jump = least.select(F.col("node").alias("label"), F.col("label").alias("far"))
        after = keep(least.join(jump, "label").select("node", F.least("label", "far").alias("label"), "was"))
        changed = not after.filter(F.col("label") != F.col("was")).isEmpty()
        drop(spark, labels)
        drop(spark, least)
        labels = after
        if not changed:
            drop(spark, both)
            return labels.select("node", "label")


def _stars(nodes: DataFrame) -> DataFrame:
    """(leader, member), each pair once, from nodes (bag, keys): every bucket is a star around its leader."""
    spark = nodes.sparkSession
    entries = nodes.select("bag", F.explode("keys").alias("key"))
    buckets = keep(entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    shared = keep(entries.join(buckets, "key"))
    # the member with most bucket-mates over all bands: the original among its edited copies
    degree = shared.groupBy("bag").agg((-F.sum("n")).alias("rank"))
    ranked = keep(shared.join(degree, "bag").select("key", "rank", "bag"))
    heads = ranked.groupBy("key").agg(F.min(F.struct("rank", "bag")).alias("l")).select("key", F.col("l.bag").alias("leader"))
    pairs = keep(ranked.join(heads, "key").filter(F.col("bag") != F.col("leader")).select("leader", F.col("bag").alias("member")).distinct())
    for used in (buckets, shared, ranked):
        drop(spark, used)
    return pairs


def _rest(stars: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between members of one star that are in different components; stars: leader, member, close, sizes and differences."""
    q = (1 - similarity) / (1 + similarity)
    named = stars.join(found.withColumnRenamed("node", "member"), "member", "left").withColumn("label", F.coalesce("label", "member"))
    several = named.groupBy("leader").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("leader")
    diff = F.concat("removed", "added")
    active = keep(named.join(several, "leader").select("leader", "member", "label", "close", "n_leader", "n", F.size("removed").alias("r"), F.size("added").alias("a"), diff.alias("diff")))
    units = active.select("leader", "member", "label", F.explode("diff").alias("unit"))
    mixed = units.groupBy("leader", "unit").agg(F.count(F.lit(1)).alias("holders"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("leader", "unit", "holders")
    ordered = units.join(mixed, ["leader", "unit"]).groupBy("leader", "member").agg(F.array_sort(F.collect_list(F.struct("holders", "unit"))).alias("units"))
    d = F.col("r") + F.col("a")
    probe = F.floor(((1 + q) * F.col("r") + (1 - q) * F.col("a")) / 2) + 1
    index = F.greatest(F.lit(1), F.ceil((d - q * (F.col("n_leader") + F.col("n"))) / 2 - 1e-9))
    sized = keep(active.drop("diff").join(ordered, ["leader", "member"]).select("leader", "member", "label", "close", "n", d.alias("d"), F.size("units").alias("k"), "units", probe.alias("probe"), index.alias("index")))

    def first(bound: str, side: str) -> DataFrame:
        """The units that bound leaves at the front, with their places."""
        own = sized.filter(F.col("k") >= F.col(bound)) if side == "x" else sized.filter(~F.col("close") & (F.col("k") >= F.col(bound)))
        at = own.select("leader", *[F.col(c).alias(f"{c}_{side}") for c in ("member", "label", "n", "d", "k")], F.posexplode(F.slice("units", F.lit(1), (F.col("k") - F.col(bound) + 1).cast("int"))).alias("place", "u"))
        return at.select("leader", F.col("u.unit").alias("unit"), *[f"{c}_{side}" for c in ("member", "label", "n", "d", "k")], (F.col("place") + 1).alias(f"place_{side}"))

    need = (F.col("d_x") + F.col("d_y") - q * (F.col("n_x") + F.col("n_y"))) / 2
    room = 1 + F.least(F.col("k_x") - F.col("place_x"), F.col("k_y") - F.col("place_y"))
    fits = (F.col("label_x") != F.col("label_y")) & (room >= need - 1e-9)
    x, y = first("probe", "x").alias("x"), first("index", "y").alias("y")
    met = x.join(y, (F.col("x.leader") == F.col("y.leader")) & (F.col("x.unit") == F.col("y.unit")) & fits)
    pairs = keep(met.select(F.col("x.leader").alias("leader"), F.least("member_x", "member_y").alias("a"), F.greatest("member_x", "member_y").alias("b")).groupBy("a", "b").agg(F.min("leader").alias("leader")))
    own = lambda c: active.select("leader", F.col("member").alias(c), F.col("diff").alias(f"diff_{c}"), F.col("n").alias(f"n_{c}"))
    both = pairs.join(own("a"), ["leader", "a"]).join(own("b"), ["leader", "b"])
    apart = F.size("diff_a") + F.size("diff_b") - 2 * F.size(F.array_intersect("diff_a", "diff_b"))
    out = keep(both.filter(apart <= q * (F.col("n_a") + F.col("n_b")) + 1e-9).select("a", "b"))
    for used in (active, sized, pairs):
        drop(stars.sparkSession, used)
    return out


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row a document: doc_id and class_id, the least doc_id of its class."""
    return _classes(docs, similarity).select("doc_id", "class_id")


def _classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row a document: doc_id, fp (the text's hash), label (of its component; null without words), class_id."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = keep(docs.select("doc_id", "text", F.xxhash64("text").alias("fp")).mapInArrow(_sign, f"doc_id {kind}, fp bigint, bag bigint, keys array<bigint>"))
    nodes = keep(signed.filter(F.col("bag").isNotNull()).groupBy("bag").agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys")))
    pairs = _stars(nodes)
    wanted = pairs.select(F.col("leader").alias("bag")).union(pairs.select("member")).distinct()
    ids = keep(nodes.join(wanted, "bag").select("node").distinct())
    # rows of one doc_id may have different texts: units are known by their bag, not by doc_id
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("node")), "left_semi").select("text")
    units = keep(texts.mapInArrow(_units, "bag bigint, units array<bigint>").dropDuplicates(["bag"]))
    mine, lead = units.select(F.col("bag").alias("member"), F.col("units").alias("mine")), units.select(F.col("bag").alias("leader"), F.col("units").alias("lead"))
    met = pairs.join(mine, "member").join(lead, "leader")
    met = met.select("leader", "member", F.size("lead").alias("n_leader"), F.size("mine").alias("n"), F.array_except("lead", "mine").alias("removed"), F.array_except("mine", "lead").alias("added"))
    shared, united = F.col("n_leader") - F.size("removed"), F.col("n_leader") + F.size("added")
    stars = keep(met.withColumn("close", shared >= similarity * united - 1e-9))
    links = stars.filter("close").select(F.col("leader").alias("a"), F.col("member").alias("b"))
    found = components(links)
    more = _rest(stars, found, similarity)
    if not more.isEmpty():
        found = components(links.union(more))
    # a class is named by its least doc_id
    firsts = found.join(nodes.select(F.col("bag").alias("node"), F.col("node").alias("doc_id")), "node")
    names = firsts.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    of = found.join(names, "label").select(F.col("node").alias("bag"), "label", "class_id")
    named = keep(nodes.join(of, "bag", "left").select("bag", F.coalesce("label", "bag").alias("label"), F.coalesce("class_id", "node").alias("class_id")))
    for used in (nodes, pairs, ids, units, stars, more):
        drop(spark, used)
    out = signed.select("doc_id", "fp", "bag").join(named, "bag", "left")
    return out.select("doc_id", "fp", "label", F.when(F.col("bag").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each class: the one of least doc_id (null last), of its texts the one of least hash.

    Rows are judged by doc_id and text, so rows of one doc_id with different texts are each judged by
    their own text; rows alike in both stay once. Rows without words are each a class and stay.
    """
    names = docs.columns
    found = keep(_classes(docs).filter(F.col("label").isNotNull()).select("doc_id", "fp", "label"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "fp")
    best = found.groupBy("label").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    judged = keep(found.join(best, "label").groupBy("doc_id", "fp").agg(F.max(order == F.col("best")).alias("stays"), F.count(F.lit(1)).alias("n")).filter("NOT stays OR n > 1"))
    marked = docs.select(*[F.col(f"`{c}`") for c in names], F.xxhash64("text").alias("_tf_fp"))
    own = lambda df: df.select(F.col("doc_id").alias("_tf_id"), F.col("fp").alias("_tf_of"))
    same = F.col("doc_id").eqNullSafe(F.col("_tf_id")) & (F.col("_tf_fp") == F.col("_tf_of"))
    single = marked.join(own(judged), same, "left_anti")
    repeated = marked.join(own(judged.filter("stays")), same, "left_semi").dropDuplicates(["doc_id", "_tf_fp"])
    return single.unionByName(repeated).drop("_tf_fp")
