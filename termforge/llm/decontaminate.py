"""Benchmark decontamination with a generalised suffix automaton over item words.

Items and documents are lower-cased (A-Z) and cut into words of digits, letters a-z and all
characters from U+0080. The automaton of all items holds every word sequence that occurs in an
item; a document's words are streamed through it and the length of the longest match that ends at
each word is tracked. A match of `window` words or more is a hit (an item of fewer words counts as
one window of its own length), and every word of the window is hit.

The benchmark is read in blocks of bounded size, one automaton a block. If there is more than one,
each block has its own pass over the texts: only one automaton is on the driver and in a worker at a
time, what each pass finds is written, and a last pass joins it to the documents. Documents are
never collected. Null and empty texts have no words and are clean; items without words are no
windows; repeated items and rows give repeated results; very long texts are streamed word by word;
extra columns stay where documents are returned and are ignored otherwise; empty tables give empty
results, an empty benchmark clean documents.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termforge.llm._store import keep

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
WINDOW = 10
#: Characters of items in one automaton; more items make more blocks.
BLOCK_CHARS = 8_000_000


class Automaton:
    """Generalised suffix automaton of word sequences."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.ids = [i for i, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws] for _, ws in items]
        for ws in coded:
            last = 0
            for c in ws:
                last = self._extend(last, c)
        whole: list[set[int]] = [set() for _ in self.next]  # items with the state's last `window` words
        short: list[set[tuple[int, int]]] = [set() for _ in self.next]
        for k, ws in enumerate(coded):
            state = 0
            for i, c in enumerate(ws):
                state = self.next[state][c]
                if i + 1 >= window:
                    whole[self._holder(state, window)].add(k)
            if 0 < len(ws) < window:
                short[self._holder(state, len(ws))].add((len(ws), k))
        #: Of each state: items of its last `window` words, and the short items that end there.
        self.items = [frozenset(whole[self._holder(s, window)]) if n >= window else frozenset() for s, n in enumerate(self.length)]
        self.shorts: list[tuple[tuple[int, int], ...]] = []
        order = sorted(range(len(self.next)), key=self.length.__getitem__)
        found: dict[int, tuple[tuple[int, int], ...]] = {}
        for s in order:
            found[s] = tuple(sorted(short[s])) + (found[self.link[s]] if self.link[s] >= 0 else ())
        self.shorts = [found[s] for s in range(len(self.next))]

    def _holder(self, state: int, n: int) -> int:
        while self.length[self.link[state]] >= n and self.link[state] >= 0:
            state = self.link[state]
        return state

    def _clone(self, of: int, length: int) -> int:
        self.next.append(dict(self.next[of]))
        self.link.append(self.link[of])
        self.length.append(length)
        return len(self.next) - 1

    def _redirect(self, state: int, c: int, old: int, new: int) -> None:
        while state >= 0 and self.next[state].get(c) == old:
            self.next[state][c] = new
            state = self.link[state]

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            if self.length[q] == self.length[last] + 1:
                return q
            copy = self._clone(q, self.length[last] + 1)
            self.link[q] = copy
            self._redirect(last, c, q, copy)
            return copy
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        new, p = len(self.next) - 1, last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            if self.length[q] == self.length[p] + 1:
                self.link[new] = q
            else:
                copy = self._clone(q, self.length[p] + 1)
                self.link[q] = self.link[new] = copy
                self._redirect(p, c, q, copy)
        return new

    def scan(self, words: list[bytes], runs: list[tuple[int, int]], items: set[str]) -> None:
        """Adds hit word ranges [from, to) to runs and the items that occur to items."""
        step, link, length, window = self.next, self.link, self.length, self.window
        state = n = 0
        found: set[int] = set()
        for i, c in enumerate(map(self.vocabulary.get, words)):
            if c is None:
                state = n = 0
                continue
            while state and c not in step[state]:
                state = link[state]
                n = length[state]
            state = step[state].get(c, 0)
            n = n + 1 if state else 0
            if n >= window:
                runs.append((i + 1 - window, i + 1))
                found |= self.items[state]
            for size, k in self.shorts[state] if state else ():
                if size <= n:
                    runs.append((i + 1 - size, i + 1))
                    found.add(k)
        items.update(self.ids[k] for k in found)


def words(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def automata(benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> tuple[int, Callable[[int], Broadcast]]:
    """(number of blocks, broadcast automaton of a block) of the benchmark (item_id, text)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("body"))
    chars = items.agg(F.sum(F.length("body"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))

    def block(k: int) -> Broadcast:
        part = items.filter(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == k).collect()
        rows = sorted((r["item"] if r["item"] is not None else "", r["body"]) for r in part)
        return benchmark.sparkSession.sparkContext.broadcast(Automaton([(i, words(t)) for i, t in rows], window))

    return blocks, block


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _hits(model: Broadcast):
    """For mapInArrow over fp, text: (fp, runs, items) of texts with a hit."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for fp, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                runs, items = [], set()
                model.value.scan(words(text.as_py()), runs, items)
                if runs:
                    rows.append((fp, [x for r in merged(runs) for x in r], sorted(items)))
            types = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["fp", "runs", "items"])

    return scan


def _found(docs: DataFrame, benchmark: DataFrame, window: int) -> tuple[DataFrame, Broadcast | None]:
    """docs with the columns _tf_runs (from, to, from, to, ...) and _tf_items, or, if one automaton holds
    the whole benchmark, with both null and that automaton."""
    blocks, block = automata(benchmark, window)
    nothing = {"_tf_runs": F.lit(None).cast("array<int>"), "_tf_items": F.lit(None).cast("array<string>")}
    if blocks == 1:
        return docs.withColumns(nothing), block(0)
    texts, parts = docs.select(F.xxhash64("text").alias("fp"), "text"), None
    for k in range(blocks):
        model = block(k)
        own = keep(texts.mapInArrow(_hits(model), "fp bigint, runs array<int>, items array<string>").dropDuplicates(["fp"]))
        model.destroy()
        parts = own if parts is None else parts.unionByName(own)
    joined = parts.groupBy("fp").agg(F.flatten(F.collect_list("runs")).alias("_tf_runs"), F.flatten(F.collect_list("items")).alias("_tf_items"))
    return docs.withColumn("_tf_fp", F.xxhash64("text")).join(joined.withColumnRenamed("fp", "_tf_fp"), "_tf_fp", "left").drop("_tf_fp"), None


def _scan_text(text: str | None, model: Automaton | None, known_runs: list[int] | None, known_items: list[str] | None) -> tuple[int, list[tuple[int, int]], list[str]]:
    """(words, hit ranges, items) of a text, by the automaton or from what the blocks found."""
    tokens = words(text)
    runs, items = list(zip(known_runs[::2], known_runs[1::2], strict=True)) if known_runs else [], set(known_items or ())
    if model is not None:
        model.scan(tokens, runs, items)
    return len(tokens), merged(runs), sorted(items)


def without_runs(text: str, runs: list[tuple[int, int]]) -> str:
    """The text without the words of the runs and what stands between them."""
    data = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in WORD.finditer(data.lower())]
    kept, pos = [], 0
    for a, b in runs:
        kept.append(data[pos : at[a][0]])
        pos = at[b - 1][1]
    kept.append(data[pos:])
    return b"".join(kept).decode("utf-8", "surrogatepass")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, items (sorted ids), runs (hit word ranges as 'from:to')."""
    rows, model = _found(docs.select("doc_id", "text"), benchmark, window)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value if model is not None else None
        for batch in batches:
            n_words, n_hit, items, spans = [], [], [], []
            for text, known_runs, known_items in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                n, runs, found = _scan_text(text.as_py(), own, known_runs.as_py(), known_items.as_py())
                n_words.append(n)
                n_hit.append(sum(b - a for a, b in runs))
                items.append(found)
                spans.append([f"{a}:{b}" for a, b in runs])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.string()))],
                ["doc_id", "n_words", "n_hit", "items", "runs"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "_tf_runs", "_tf_items").mapInArrow(scan, f"doc_id {kind}, n_words bigint, n_hit bigint, items array<string>, runs array<string>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_covered: float = 0.5) -> DataFrame:
    """docs with hit spans cut out of text; documents of which more than `most_covered` is hit are removed.

    Untouched documents stay as they are. n_chars, where there is such a column, follows the text.
    """
    names = docs.columns
    rows, model = _found(docs, benchmark, window)
    at, count = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.value if model is not None else None
        for batch in batches:
            texts, keep_row = batch.column(at).to_pylist(), []
            for k, (text, known_runs, known_items) in enumerate(zip(texts, batch.column(len(names)), batch.column(len(names) + 1), strict=True)):
                n, runs, _ = _scan_text(text, automaton, known_runs.as_py(), known_items.as_py())
                hit = sum(b - a for a, b in runs)
                keep_row.append(not hit or hit <= most_covered * n)
                if hit and keep_row[-1]:
                    texts[k] = without_runs(text, runs)
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if count is not None:
                was = columns[count].to_pylist()
                columns[count] = pa.array([len(t) if t is not None and t != o else c for t, o, c in zip(texts, batch.column(at).to_pylist(), was, strict=True)], batch.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep_row, pa.bool_()))

    return rows.select(*[F.col(f"`{c}`") for c in names], "_tf_runs", "_tf_items").mapInArrow(clean, docs.schema)
