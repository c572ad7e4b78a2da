"""Personal data: fixed patterns, and terms that give protected entities away.

Patterns find emails, IPv4 addresses, card numbers (Luhn) and phone numbers; each value is a
protected entity. Corpus co-occurrence estimates what a term t of a text tells about an entity e,
all four counts in distinct texts (copies count once): own (texts with e), n (with t), joint (with
both), N (all).

    PMI(e; t) = log2(joint N / (own n)),    P(e | t) = joint / n

t reveals e if PMI(e; t) reaches the information of e's generalisation, log2(N / texts with any
entity of its kind), so that t says at least as much as the kind that would replace e, and P(e | t)
reaches `posterior`. Whole texts are counted, not windows. Only entities of `support` distinct texts
or more can be estimated; near copies aren't independent: a min-hash sketch of word pairs gives each
entity's texts an effective number (inverse Simpson index of the registers, averaged), which must
reach `effective`. A revealing term is a span of kind `term` in every text that holds it, with or
without the entity printed, and is generalised like the entities.

Null and empty texts have no spans. Repeated rows give repeated results, in any order, as do rows
without doc_id. Very long texts are scanned whole, in time linear in their length. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termforge.llm import _bytes as B
from termforge.llm._store import drop, keep

# Fixed patterns of the kinds, in the order of the output.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")
DIGIT, NOT_DIGIT, TERM = re.compile("[0-9]"), re.compile("[^0-9]"), re.compile(r"[^\W\d_]{3,}")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
#: IP in linear time: its matches are each four parts in a row of a maximal chain of digit runs.
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
#: Revealing terms in one broadcast; more of them are applied one block after another.
TERMS_AT_ONCE = 500_000
REGISTERS = 16


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As EMAIL.finditer, but looked for only where an @ is: a match starts in the run of local characters before it."""
    pos, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > pos and text[start - 1] in LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            yield m.span()
            pos = m.end()
        at = text.find("@", max(at + 1, pos))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """As IP.finditer, without those that have a part above 255."""
    for m in DOTTED.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            size = sum(map(len, parts[k : k + 4])) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts[k : k + 4]):
                yield at, at + size
            at += size + 1


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind, then start."""
    if not text:
        return []
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", a, b) for a, b in _addresses(text)]
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m.group()) if m.end() - m.start() >= 13 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15]
    return out


def entity(kind: str, value: str) -> str:
    """Short key of an entity: the same for spellings of one number."""
    own = value.lower() if kind in ("email", "ip") else NOT_DIGIT.sub("", value)
    return hashlib.blake2b(f"{kind}:{own}".encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def free_terms(text: str, spans: list[tuple[str, int, int]]) -> Iterator[re.Match]:
    """Matches of TERM outside the spans, from left to right."""
    taken = sorted((a, b) for _, a, b in spans)
    starts, reach = [a for a, _ in taken], np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []
    for m in TERM.finditer(text):
        k = bisect_left(starts, m.end())  # spans that begin before the term ends
        if not k or reach[k - 1] <= m.start():
            yield m


def words_of(text: str) -> set[str]:
    """The terms of a text, as those of TERM: whole words of letters are taken as they are, others cut."""
    tokens = set(text.split())
    out = {t.lower() for t in tokens if len(t) > 2 and t.isalpha()}
    out.update(m.lower() for t in tokens if not t.isalpha() for m in TERM.findall(t))
    return out


#: ASCII letters in lower case, all other ASCII characters as spaces, bytes of other characters as they are.
_LETTERS = bytes(c | 32 if chr(c).isascii() and chr(c).isalpha() else c if c > 127 else 32 for c in range(256))


class Wanted:
    """A set of terms to look for in texts: words are cut from bytes, which takes a third of the pattern's time."""

    def __init__(self, terms: frozenset[str]) -> None:
        self.terms = terms
        self.encoded = {t.encode("utf-8", "surrogatepass") for t in terms}

    def held(self, text: str) -> set[str]:
        """words_of(text) that are wanted."""
        if "İ" in text or "Σ" in text:  # whose lower case depends on what stands around
            return words_of(text) & self.terms
        ascii_only = text.isascii()
        words = (text if ascii_only else text.lower()).encode("utf-8", "surrogatepass").translate(_LETTERS).split()
        found = {w.decode("utf-8", "surrogatepass") for w in self.encoded.intersection(words)}
        if not ascii_only:  # words that hold other than letters are cut by the pattern
            for w in {w for w in words if not w.isascii()}:
                if not (word := w.decode("utf-8", "surrogatepass")).isalpha():
                    found.update(self.terms.intersection(TERM.findall(word)))
        return found


def sketch(text: str) -> list[int]:
    """Min-hash registers of a text's word pairs."""
    words, first = B.word_hashes(pa.array([text]))
    pairs, _ = B.ngrams(words, first, 2 if len(words) > 1 else 1)
    return [int(B.mix(pairs + B.U(k + 1)).min(initial=B.U(2**64 - 1)).view(np.int64)) for k in range(REGISTERS)]


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, kind, entity, sketch) of each entity of a text."""
    for batch in batches:
        rows: list[tuple] = []
        for fp, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            spans = base_spans(text := text.as_py())
            if spans:
                own = sketch(text)
                rows += [(fp, kind, key, own) for kind, key in sorted({(k, entity(k, text[a:b])) for k, a, b in spans})]
        types = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["fp", "kind", "entity", "sketch"])


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, terms): the distinct terms of a text outside its entities."""
    for batch in batches:
        found = [sorted({m.group().lower() for m in free_terms(t.as_py(), base_spans(t.as_py()))}) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], ["fp", "terms"])


def _counts(wanted):
    """For mapInArrow over fp, text: (term, n), the texts of a batch that hold each term; of `wanted` only, if given."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = wanted.value if wanted else None
        for batch in batches:
            total: Counter = Counter()
            for text in batch.column(1):
                text = text.as_py()
                total.update(words_of(text) if only is None else only.held(text))
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["term", "n"])

    return count


def _distinct_texts(docs: DataFrame) -> DataFrame:
    """fp, text: each text once; only texts that have copies are shuffled."""
    marked = docs.select(F.coalesce("text", F.lit("")).alias("text")).select(F.xxhash64("text").alias("fp"), "text")
    copied = keep(marked.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fp"))
    return marked.join(copied, "fp", "left_anti").unionByName(marked.join(copied, "fp", "left_semi").dropDuplicates(["fp"]))


def revealing_terms(docs: DataFrame, support: int = 3, posterior: float = 0.2, effective: float = 1.5) -> DataFrame:
    """(term, entity): what the whole corpus says gives an entity away."""
    spark = docs.sparkSession
    every = docs.select(F.coalesce("text", F.lit("")).alias("text")).select(F.xxhash64("text").alias("fp"), "text")
    seen = keep(every.mapInArrow(_entities, "fp bigint, kind string, entity string, sketch array<bigint>").dropDuplicates(["fp", "entity"]))
    registers = seen.select("entity", F.posexplode("sketch").alias("register", "value")).groupBy("entity", "register", "value").agg(F.count(F.lit(1)).alias("c"))
    each = registers.groupBy("entity", "register").agg(F.sum("c").alias("own"), F.sum(F.col("c") * F.col("c")).alias("squares"))
    weighed = each.groupBy("entity").agg(F.max("own").alias("own"), F.avg(F.col("squares") / (F.col("own") * F.col("own"))).alias("share"))
    strong = keep(weighed.filter((F.col("own") >= support) & (F.col("share") * effective <= 1)).select("entity", "own"))
    if strong.isEmpty():
        drop(spark, seen)
        return spark.createDataFrame([], "term string, entity string")
    pairs = keep(seen.join(strong, "entity").select("fp", "kind", "entity", "own"))
    texts = _distinct_texts(docs)
    held = every.join(pairs.select("fp").distinct(), "fp", "left_semi").dropDuplicates(["fp"]).mapInArrow(_holders, "fp bigint, terms array<string>")
    joint = pairs.join(held, "fp").select("kind", "entity", "own", F.explode("terms").alias("term")).groupBy("kind", "entity", "own", "term").agg(F.count(F.lit(1)).alias("joint"))
    joint = keep(joint.filter(F.col("joint") >= support))
    terms = keep(joint.select("term").distinct())
    total = every.select("fp").distinct().count()
    # few candidates are looked for; more than a broadcast may hold are counted with all other terms
    few = terms.count() <= TERMS_AT_ONCE
    wanted = spark.sparkContext.broadcast(Wanted(frozenset(r[0] for r in terms.collect()))) if few else None
    counted = texts.mapInArrow(_counts(wanted), "term string, n long")
    holding = keep((counted if few else counted.join(terms, "term", "left_semi")).groupBy("term").agg(F.sum("n").alias("n")))
    if few:
        wanted.unpersist()
    kinds = seen.groupBy("kind").agg(F.countDistinct("fp").alias("of_kind"))
    pmi = F.log2(F.col("joint") * F.lit(float(total)) / (F.col("own") * F.col("n")))
    told = joint.join(holding, "term").join(F.broadcast(kinds), "kind")  # kinds: four rows
    found = keep(told.filter((F.col("joint") >= posterior * F.col("n")) & (pmi >= F.log2(F.lit(float(total)) / F.col("of_kind")))).select("term", "entity"))
    for used in (seen, strong, pairs, joint, terms, holding):
        drop(spark, used)
    return found


def _scan(wanted, sanitised: bool):
    """For mapInArrow over doc_id, text and, after the first block, spans found so far."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = wanted.value if wanted else None
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text in batch.column(1):
                text = text.as_py()
                spans = base_spans(text)
                if own and text and (terms := own.held(text)):
                    spans += [("term", *m.span()) for m in free_terms(text, spans) if m.group().lower() in terms]
                for k in range(3):
                    out[k].append([s[k] for s in spans])
                out[3].append(replaced(text, spans) if sanitised else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out[0], pa.list_(pa.string())), pa.array(out[1], pa.list_(pa.int32())), pa.array(out[2], pa.list_(pa.int32())), pa.array(out[3], pa.string())],
                ["doc_id", "kinds", "starts", "ends", "clean"],
            )

    return scan


def _marker(wanted):
    """For mapInArrow over text and terms: adds those of the block's terms that the text holds."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(wanted.value.held(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], ["fp", "terms"])

    return mark


def _known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As _scan's output for rows doc_id, text, terms, where terms are those to look for in the text."""
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            spans, own = base_spans(text), frozenset(own or ())
            spans += [("term", *m.span()) for m in free_terms(text or "", spans) if m.group().lower() in own]
            for k in range(3):
                out[k].append([s[k] for s in spans])
            out[3].append(replaced(text, spans))
        types = (pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, t) for x, t in zip(out, types, strict=True)]], ["doc_id", "kinds", "starts", "ends", "clean"])


def find(docs: DataFrame, sanitised: bool = False) -> DataFrame:
    """One row a document: doc_id, kinds, starts, ends (arrays, ordered), and clean (text with spans generalised) if sanitised."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, kinds array<string>, starts array<int>, ends array<int>, clean string"
    pairs = revealing_terms(docs)
    terms = keep(pairs.select("term").distinct())
    n = terms.count()
    if n <= TERMS_AT_ONCE:
        wanted = spark.sparkContext.broadcast(Wanted(frozenset(r[0] for r in terms.collect()))) if n else None
        found = docs.select("doc_id", "text").mapInArrow(_scan(wanted, sanitised), out)
    else:  # the terms of each text block by block, one broadcast at a time; then each text with its own
        blocks, texts, marked = -(-n // TERMS_AT_ONCE), _distinct_texts(docs), []
        for k in range(blocks):
            own = spark.sparkContext.broadcast(Wanted(frozenset(r[0] for r in terms.filter(F.pmod(F.xxhash64("term"), F.lit(blocks)) == k).collect())))
            marked.append(keep(texts.mapInArrow(_marker(own), "fp bigint, terms array<string>").filter(F.size("terms") > 0)))
            own.unpersist()
        all_terms = marked[0]
        for more in marked[1:]:
            all_terms = all_terms.unionByName(more)
        held = all_terms.groupBy("fp").agg(F.flatten(F.collect_list("terms")).alias("terms"))
        rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("fp")).join(held, "fp", "left")
        found = rows.select("doc_id", "text", "terms").mapInArrow(_known, out)
    return found if sanitised else found.drop("clean")


def replaced(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """Entities become their kind in brackets, revealing terms the general word [TERM]; overlaps are joined under the first kind."""
    if not text or not spans:
        return text
    out, pos = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= pos:
            out += [text[pos:a], f"[{kind.upper()}]"]
        pos = max(pos, b)
    return "".join([*out, text[pos:]])
