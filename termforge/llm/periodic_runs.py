"""Periodic runs of words: maximal stretches that repeat with their smallest period at least twice.

A run is a stretch of consecutive words with smallest period q and at least max(least, 2 q) words that
no neighbouring word extends keeping period q. All runs of a text are found, and its words without
the repeats: of each run the first q words stay, unless another run drops them.

1. Candidates: every word of a run lies in a sequence of GRAM words that the run holds twice (a run has
   at least 2 q and at least 2 GRAM words, so what starts in its first part comes again q further on).
   Words in no sequence found twice can't be in a run; the rest falls into stretches, in which the same
   is asked again until nothing changes. This loses no run: a stretch holds every run that it touches.
2. Each stretch gets a suffix automaton. Ordered sets of end positions are merged from the longest
   states up, the smaller into the larger. A position that joins a set gets new neighbours; a distance d
   to one that is at most the state's length L seeds a square: L + d words with period d, which can't
   start earlier. In a run with smallest period q the ends of two adjacent copies are neighbours when
   they first meet, since nothing shorter than q lies between them; so every run is seeded.
3. A seed is extended to the right while words d apart are equal. Of seeds with the same stretch of
   words the least period is its smallest.

Words are cut at white space and compared exactly, case-sensitively. Null and empty texts have no words
and no runs. Very long texts are never cut; they take about 60 bytes a word, and some 500 a word of
their candidate stretches, one after another. Repeated rows give repeated results. Runs that share
their words are all reported, ordered by start and period. Columns other than text are carried if named;
an empty table gives an empty one. Rows are independent: nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termforge.session import ship

LEAST, GRAM = 12, 6
SPACE = r"[\x20\x09-\x0D]+"


def stretches(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Where runs can be: parts in which every word lies in a sequence of `gram` words found twice in the part."""
    gram = least // 2
    n = len(ids)
    if n < least:
        return []
    grams = np.zeros(n - gram + 1, np.uint64)
    for k in range(gram):
        grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25) + ids[k : k + len(grams)]
    todo, out = [(0, n)], []
    while todo:
        a, b = todo.pop()
        own = grams[a : b - gram + 1]
        order = np.argsort(own, kind="stable")
        same = own[order][1:] == own[order][:-1]
        if not same.any():
            continue
        twice = np.zeros(b - a + 1, np.int64)
        begin = np.unique(np.concatenate((order[1:][same], order[:-1][same])))
        twice[begin] += 1
        np.subtract.at(twice, begin + gram, 1)
        inner = np.concatenate(([False], np.cumsum(twice[:-1]) > 0, [False]))
        edges = np.flatnonzero(inner[1:] != inner[:-1])
        parts = [(a + int(x), a + int(y)) for x, y in edges.reshape(-1, 2) if y - x >= least]
        if parts == [(a, b)]:
            out.append((a, b))
        else:
            todo += parts
    return sorted(out)


class Places:
    """An ordered set of numbers in blocks of bounded length."""

    __slots__ = ("blocks", "heads", "size")
    MOST = 1024

    def __init__(self, x: int) -> None:
        self.blocks, self.heads, self.size = [[x]], [x], 1

    def add(self, x: int) -> tuple[int, int]:
        """Puts x, which isn't there, in; its neighbours before and after, or -1."""
        heads, blocks = self.heads, self.blocks
        k = max(0, bisect_left(heads, x) - 1)
        own = blocks[k]
        at = bisect_left(own, x)
        before = own[at - 1] if at else -1
        after = own[at] if at < len(own) else heads[k + 1] if k + 1 < len(heads) else -1
        own.insert(at, x)
        heads[k] = own[0]
        self.size += 1
        if len(own) > self.MOST:
            half = len(own) // 2
            blocks.insert(k + 1, own[half:])
            heads.insert(k + 1, own[half])
            del own[half:]
        return before, after

    def __iter__(self) -> Iterator[int]:
        for own in self.blocks:
            yield from own


def automaton(s: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The suffix automaton's states: length, suffix link, and the end position that a state was made for, or -1."""
    size, link, end, go = [0], [-1], [-1], [{}]
    last = 0
    for i, c in enumerate(s):
        new, p = len(size), last
        size.append(i + 1)
        link.append(0)
        end.append(i)
        go.append({})
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if size[p] + 1 != size[q]:
                copy = len(size)
                size.append(size[p] + 1)
                link.append(link[q])
                end.append(-1)
                go.append(go[q].copy())
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                link[q] = q = copy
            link[new] = q
        last = new
    return size, link, end


def seeds(s: list[int]) -> dict[tuple[int, int], int]:
    """(start, distance) of squares, and the last word that one of them is known to reach."""
    size, link, end = automaton(s)
    held: list[Places | None] = [Places(e) if e >= 0 else None for e in end]
    found: dict[tuple[int, int], int] = {}
    for v in sorted(range(1, len(size)), key=size.__getitem__, reverse=True):
        up = link[v]
        own, held[v] = held[v], None
        if up <= 0 or own is None:
            continue
        other = held[up]
        if other is None:
            held[up] = own
            continue
        if own.size > other.size:
            own, other = other, own
        length, last = size[up], -1
        for x in own:
            a, b = other.add(x)
            if a > last and x - a <= length:  # two of the smaller set have met before, in a longer state
                key = (a - length + 1, x - a)
                found[key] = max(x, found.get(key, 0))
            if b >= 0 and b - x <= length:
                key = (x - length + 1, b - x)
                found[key] = max(b, found.get(key, 0))
            last = x
        held[up] = other
    return found


def reach(s: np.ndarray, at: int, period: int) -> int:
    """The first place from `at` on whose word differs from that `period` before it."""
    step = 32
    while at < len(s):
        own = s[at : at + step]
        differ = np.flatnonzero(own != s[at - period : at - period + len(own)])
        if len(differ):
            return at + int(differ[0])
        at += len(own)
        step *= 2
    return at


def runs(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period."""
    out = []
    for a, b in stretches(ids, least):
        s = ids[a:b]
        best: dict[tuple[int, int], int] = {}
        for (start, period), last in seeds(s.tolist()).items():
            stop = reach(s, last + 1, period)
            best[start, stop] = min(period, best.get((start, stop), period))
        out += [(a + start, stop - start, q) for (start, stop), q in best.items() if stop - start >= max(least, 2 * q)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def analyse(text: bytes, least: int = LEAST) -> tuple[int, list[tuple[int, int, int]], bytes]:
    """(number of words, runs, the words that stay, joined by one space)."""
    words = text.split()  # bytes are cut at the six ASCII white spaces, no others
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    found = runs(ids, least)
    if found:
        gone = np.zeros(len(words) + 1, np.int64)
        for start, length, period in found:
            gone[start + period] += 1
            gone[start + length] -= 1
        words = [words[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
    return len(ids), found, b" ".join(words)


RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def detect(docs: DataFrame, *carry: str, least: int = LEAST) -> DataFrame:
    """carry columns, n_words, runs (array of start, length, period) and collapsed (binary) of each row's text."""
    ship(docs.sparkSession)
    run_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [analyse(t.as_py() or b"", least) for t in batch.column(batch.num_columns - 1)]
            own = [[{"start": s, "length": n, "period": q} for s, n, q in r] for _, r, _ in done]
            made = [pa.array([n for n, _, _ in done], pa.int64()), pa.array(own, run_type), pa.array([c for _, _, c in done], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*batch.schema.names[:-1], "n_words", "runs", "collapsed"])

    rows = docs.select(*[F.col(f"`{c}`") for c in carry], F.col("text").cast("binary").alias("_tf_text"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}n_words bigint, runs {RUNS}, collapsed binary")


def planted(text: Column, key: Column) -> Column:
    """The text with its words repeated periodically from some place on, in every tenth row by a hash of the key.

    h: CRC-32 of the key's decimal text, g = floor(h / 10); with h % 10 = 0 word i >= a becomes word
    a + (i - a) % p, where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). Other rows, and those without key
    or words, stay as they are.
    """
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeat(words: Column) -> Column:
        n = F.size(words).cast("long")

        def with_start(a: Column) -> Column:
            p = F.floor((n - a) / (3 + g % 8)).cast("long") + 1
            return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " ")

        return F.when(n > 0, F.get(F.transform(F.array(g % n), with_start), F.lit(0))).otherwise(text)

    return F.when(h % 10 == 0, F.get(F.transform(F.array(F.array_remove(F.split(text, SPACE), "")), repeat), F.lit(0))).otherwise(text)
