"""Exact substring dedup on suffix order: bytes covered by a 100-byte string that starts earlier go.

1. Windows of `length` bytes are grouped to runs by their anchor, the window's least k-gram: equal
   windows have equal anchors at equal offsets. A block of documents sends its distinct (anchor,
   run content) pairs with their first places to the anchor's range of the hash space. A run whose
   content starts earlier elsewhere is removed whole; a run whose anchor no other content shares
   stays. Copies, however many, end here: one entry a block, one content in all.
2. Of each content that shares its anchor with others, the first occurrence sends its bytes on, in
   two pieces: windows with the anchor in their first half agree on the bytes right of it, others on
   those left of it, and each piece goes to the range of these core bytes' hash. So contents that
   share a frequent anchor and little more are spread over all ranges, and a piece whose core no
   other has is done. In a range the suffixes of the pieces that share cores are sorted by the
   difference-cover method (cover {1, 2} mod 3): sampled triples are sorted and named, names are
   sorted by recursion until a name spans `length` bytes, remaining suffixes are merged in;
   neighbours in suffix order are compared on their first `length` bytes, equal ones are one string,
   and all its places but the first are removed. A core with more than SORT_BYTES of pieces is split
   by longer cores first, so a sort's memory is bounded.

Equal windows always meet in one range, so ranges are sorted independently of each other. Anchors,
contents and cores are known by 64-bit hashes, the strings of a sort are compared byte by byte.
doc_id must be integral; null is before all. Null and empty texts have no bytes; texts shorter than
`length` stay. Of repeated rows of one doc_id, equal places are one place: neither removes the
other, whatever their texts. A very long text is never cut; its arrays take about 80 bytes a byte of
it in a worker. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termforge.llm import _blocks as K
from termforge.llm import _bytes as B
from termforge.llm._store import keep

LENGTH, GRAM = 100, 24
NULL_ID = np.iinfo(np.int64).min


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    rows = -(-len(x) // width)
    padded = np.full(rows * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    table = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(table, 1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs(body: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor hash, content hash, document, start in document, windows, anchor's offset in the first one) of each run of a document's windows with one anchor."""
    none = np.zeros(0, np.uint64)
    if len(body) < length:
        return none, none, *[none.astype(np.int64)] * 4
    sums = B.prefix(body)
    starts = np.arange(len(body) - gram + 1)
    hashes = B.hash_range(sums, starts, starts + gram)
    bits = B.U(max(1, int(len(hashes)).bit_length()))
    least = sliding_least((hashes >> bits << bits) | starts.astype(np.uint64), length - gram + 1)
    anchor = (least & ((B.U(1) << bits) - B.U(1))).astype(np.int64)
    size = np.diff(at)
    room = np.maximum(size - length + 1, 0)
    docs = np.repeat(np.arange(len(size)), room)
    first = np.repeat(at[:-1], room) + np.arange(len(docs)) - np.repeat(np.cumsum(room) - room, room)
    own = anchor[first]
    new = np.ones(len(first), bool)
    new[1:] = (own[1:] != own[:-1]) | (docs[1:] != docs[:-1])
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(first)))
    begin, place = first[head], own[head]
    content = B.mix(B.hash_range(sums, begin, begin + n - 1 + length) + (place - begin).astype(np.uint64))
    # an anchor's hash is the least of many; mixed again, anchors spread evenly over the ranges
    return B.mix(hashes[place]), content, docs[head], begin - at[docs[head]], n, place - begin


def block_runs(table: pa.Table, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """runs() of a block's documents, with the document's row in the block."""
    found, base = [], 0
    for chunk in table.column(1).chunks:
        h, c, d, s, n, p = runs(*B.raw(chunk), length, gram)
        found.append((h, c, d + base, s, n, p))
        base += len(chunk)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def entries(ids: np.ndarray, found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, index): runs sorted by anchor, content, place; where an entry begins in that order; each sorted run's entry."""
    anchor, content, doc, start = found[:4]
    order = np.lexsort((start, ids[doc], content, anchor))
    new = np.ones(len(order), bool)
    a, c = anchor[order], content[order]
    new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _ids(table: pa.Table) -> np.ndarray:
    return np.array([NULL_ID if v is None else v for v in table.column(0).to_pylist()], np.int64)


def _ask(parts: int, length: int, gram: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in K.thawed(batches):
            ids, found = _ids(table), block_runs(table, length, gram)
            order, first, _ = entries(ids, found)
            head = order[first]
            anchor, content, doc, start = found[0][head], found[1][head], ids[found[2][head]], found[3][head]
            cut = K.cuts(anchor, parts)
            rows: list[tuple] = []
            for p, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                if b > a:
                    rows.append((p, number, K.pack_sorted(anchor[a:b]), K.pack(content[a:b]), K.pack(doc[a:b]), K.pack(start[a:b])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), *[pa.binary()] * 4))], ["part", "block", "a", "b", "c", "d"])

    return ask


def _judge(table: pa.Table) -> pa.Table:
    """Of one range, for each block's entries in order: 0 first and alone, 1 removed, 2 first of several contents of its anchor."""
    read = lambda column, i, kind: K.unpack(table.column(column)[i].as_py(), kind)
    n = table.num_rows
    anchors = [K.unpack_sorted(table.column("a")[i].as_py()) for i in range(n)]
    anchor = np.concatenate(anchors)
    content, doc, start = (np.concatenate([read(c, i, k) for i in range(n)]) for c, k in (("b", np.uint64), ("c", np.int64), ("d", np.int64)))
    order = np.lexsort((start, doc, content, anchor))
    a, c = anchor[order], content[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = a[1:] != a[:-1]
    new = fresh.copy()
    new[1:] |= c[1:] != c[:-1]
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    d, s = doc[order], start[order]
    later = (d != d[head]) | (s != s[head])
    group = np.cumsum(fresh) - 1
    several = np.bincount(group, new)[group] > 1
    code = np.empty(len(order), np.uint8)
    code[order] = np.where(later, 1, np.where(several, 2, 0))
    ends = np.cumsum([len(x) for x in anchors])
    packed = [K.pack(code[x:y]) for x, y in zip(np.concatenate(([0], ends[:-1])), ends, strict=True)]
    return pa.table({"block": table.column("block"), "part": table.column("part"), "codes": pa.array(packed, pa.binary())})


def _by_part(answers: pa.Table, column: str) -> list[bytes]:
    rows = sorted(zip(answers.column("part").to_pylist(), answers.column(column).to_pylist(), strict=True), key=lambda r: r[0])
    return [r[1] for r in rows]


def _codes(answers: pa.Table) -> np.ndarray:
    return np.concatenate([K.unpack(x, np.uint8) for x in _by_part(answers, "codes")] or [np.zeros(0, np.uint8)])


def row_hashes(rows: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of a matrix of bytes."""
    out = np.full(len(rows), rows.shape[1], np.uint64)
    for column in rows.T:
        out = B.mix(out * B.U(0x9FB21C651E98DF25) + column.astype(np.uint64) + B.U(1))
    return out


def cores(body: np.ndarray, place: np.ndarray, low: int, high: int, length: int, gram: int) -> np.ndarray:
    """Hash of the bytes that all windows share which have the anchor (at place) at offsets from low to high."""
    width, out = low + length - high, []
    step = max(1, SORT_BYTES // width)
    for k in range(0, len(place), step):
        out.append(row_hashes(body[place[k : k + step, None] + np.arange(-low, length - high)]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def pieces(body: np.ndarray, at: np.ndarray, found: tuple[np.ndarray, ...], head: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(core, run, begin in body, windows, anchor's offset in the first one) of the two pieces of the runs `head`, sorted by core."""
    _, _, doc, start, n, top = (x[head] for x in found)
    begin = at[doc] + start
    place, half, last = begin + top, (length - gram) // 2, length - gram
    out = []
    for low, high in ((0, half), (half + 1, last)):
        most, least = np.minimum(top, high), np.maximum(top - n + 1, low)
        mine = np.flatnonzero(most >= least)
        out.append((cores(body, place[mine], low, high, length, gram), head[mine], (place - most)[mine], (most - least + 1)[mine], most[mine]))
    core, run, first, windows, offset = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((first, core))
    return tuple(x[order] for x in (core, run, first, windows, offset))


def _rest(parts: int, length: int, gram: int):
    """The bytes of runs with code 2, in two pieces, to their cores' ranges."""

    def rest(key, texts: pa.Table, answers: pa.Table) -> pa.Table:
        table = K.thaw(texts.column("body")[0].as_py())
        ids, found, code = _ids(table), block_runs(table, length, gram), _codes(answers)
        order, first, _ = entries(ids, found)
        body, at = B.raw(pa.concat_arrays(table.column(1).chunks))
        core, run, begin, n, offset = pieces(body, at, found, order[first][code == 2], length, gram)
        doc = found[2][run]
        start, ids = begin - at[doc], ids[doc]
        cut = K.cuts(core, parts)
        rows = []
        for p, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if b > a:
                data = b"".join(body[x : x + m - 1 + length].tobytes() for x, m in zip(begin[a:b], n[a:b], strict=True))
                packed = (np.frombuffer(data, np.uint8), ids[a:b], start[a:b], n[a:b].astype(np.int16), offset[a:b].astype(np.int16))
                rows.append((p, texts.column("block")[0].as_py(), *map(K.pack, packed), K.pack_sorted(core[a:b])))
        types = (("part", pa.int32()), ("block", pa.int64()), *[(c, pa.binary()) for c in "abcdfe"])
        return pa.table({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(types)}).select(["part", "block", "a", "b", "c", "d", "e", "f"])

    return rest


def _pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One key for two non-negative keys, order kept."""
    if int(x.max(initial=0)).bit_length() + (wide := int(y.max(initial=0)).bit_length()) > 63:
        x = np.unique(x, return_inverse=True)[1]
    return (x.astype(np.int64) << wide) | y.astype(np.int64)


def suffix_order(text: np.ndarray, depth: int, span: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(order, class): suffixes sorted by at least their first `depth` bytes; suffixes that agree so far may share a class.

    text: positive integers, each a name of `span` bytes.
    """
    n = len(text)
    if n < 4:
        keys = [tuple(text[i:]) for i in range(n)]
        order = sorted(range(n), key=keys.__getitem__)
        return np.array(order, np.int64), np.argsort(order).astype(np.int64)
    t = np.concatenate((text.astype(np.int64), np.zeros(4, np.int64)))
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate((one, two))
    names, rank = np.unique(_pair(_pair(t[sample], t[sample + 1]), t[sample + 2]), return_inverse=True)
    if len(names) < len(sample) and 3 * span < depth:
        rank = suffix_order(rank + 1, depth, 3 * span)[1]
    of = np.zeros(n + 4, np.int64)
    of[sample] = rank + 1
    zero = np.arange(0, n, 3)
    one = one[one < n]
    width = int(of.max()).bit_length()
    if 2 * int(t.max()).bit_length() + width > 63:  # names of pairs instead of the pairs
        pairs = np.unique(_pair(t[: n + 2], t[1 : n + 3]), return_inverse=True)[1]
    else:
        pairs = (t[: n + 2] << int(t.max()).bit_length()) | t[1 : n + 3]
    by_one = lambda i: (t[i] << width) | of[i + 1]
    by_two = lambda i: (pairs[i] << width) | of[i + 2]
    zero = zero[np.argsort(by_one(zero), kind="stable")]
    one = one[np.argsort(of[one], kind="stable")]
    two = two[np.argsort(of[two], kind="stable")]
    others = np.concatenate((one, two))
    others = others[np.argsort(of[others], kind="stable")]
    before = np.searchsorted(by_one(one), by_one(zero), "right") + np.searchsorted(by_two(two), by_two(zero), "right")
    order = np.insert(others, before, zero)
    # suffixes of one class: equal first bytes and equal classes of what follows
    a, b = order[:-1], order[1:]
    same = np.zeros(n, bool)
    kind_a, kind_b = a % 3, b % 3
    both = (kind_a != 0) & (kind_b != 0)
    with_one = ~both & (kind_a != 2) & (kind_b != 2)
    same[1:] = np.where(both, of[a] == of[b], np.where(with_one, by_one(a) == by_one(b), by_two(a) == by_two(b)))
    classes = np.empty(n, np.int64)
    classes[order] = np.cumsum(~same) - 1
    return order, classes


def equal_neighbours(body: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Of each two neighbours in suffix order, whether they agree in their first `length` bytes."""
    eight = np.zeros(len(body), np.uint64)  # the eight bytes from each place
    for k in range(8):
        eight[: len(body) - k] |= body[k:].astype(np.uint64) << B.U(8 * k)
    a, b = order[:-1], order[1:]
    left = np.arange(len(a))
    for k in [*range(0, length - 7, 8), length - 8] if length >= 8 else range(length):
        same = eight[a[left] + k] == eight[b[left] + k] if length >= 8 else body[a[left] + k] == body[b[left] + k]
        left = left[same]
    out = np.zeros(len(a), bool)
    out[left] = True
    return out


def repeats(body: np.ndarray, begin: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """True where a window of a run starts whose string also starts at an earlier place; runs lie one after another in body."""
    order, _ = suffix_order(body.astype(np.int64) + 1, length)
    inside = np.ones(len(body), bool)  # a window starts here and ends in its run
    inside[np.repeat(begin + n, length - 1) + np.tile(np.arange(length - 1), len(n))] = False
    order = order[inside[order]]
    new = np.ones(len(order), bool)
    new[1:] = ~equal_neighbours(body, order, length)
    group = np.cumsum(new) - 1
    run = np.searchsorted(begin, order, "right") - 1
    d, s = doc[run], start[run] + order - begin[run]
    place = np.lexsort((s, d, group))
    head = place[np.flatnonzero(new)][group]
    later = np.zeros(len(body), bool)
    later[order] = (d != d[head]) | (s != s[head])
    return later


#: Bytes sorted at once (twice as many at most).
SORT_BYTES = 256 << 10


def _taken(body: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, bytes there, new begins) of some ranges laid one after another."""
    fresh = np.cumsum(size) - size
    at = np.repeat(begin - fresh, size) + np.arange(int(size.sum()))
    return at, body[at], fresh


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by key, where groups of two or more begin in it, their sizes)."""
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    edge = np.flatnonzero(new)
    size = np.diff(np.append(edge, len(key)))
    return order, edge[size > 1], size[size > 1]


def _later(body: np.ndarray, begin: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray, offset: np.ndarray, core: np.ndarray, length: int, gram: int) -> np.ndarray:
    """True where a window of a piece starts that has an equal one at an earlier place."""
    later = np.zeros(len(body), bool)
    place, half = begin + offset, (length - gram) // 2
    ready: list[tuple[np.ndarray, int, int]] = []  # pieces that share a core, and the offsets looked at
    order, edge, size = _groups(core)
    left = [(order[a : a + k], *((0, half) if offset[order[a]] <= half else (half + 1, length - gram))) for a, k in zip(edge.tolist(), size.tolist(), strict=True)]

    def windows(own: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """(begin, number) of the pieces' windows with the anchor at those offsets."""
        most, least = np.minimum(offset[own], high), np.maximum(offset[own] - n[own] + 1, low)
        return place[own] - most, most - least + 1

    while left:
        own, low, high = left.pop()
        first, number = windows(own, low, high)
        if int((number - 1 + length).sum()) <= SORT_BYTES:
            ready.append((own, low, high))
        elif low == high:  # the core is the whole window: all are equal
            d, s = doc[own], start[own] + first - begin[own]
            least = np.lexsort((s, d))[0]
            later[first] |= (d != d[least]) | (s != s[least])
        else:
            mid = (low + high) // 2
            for a, b in ((low, mid), (mid + 1, high)):
                inner = own[windows(own, a, b)[1] > 0]
                order, edge, size = _groups(cores(body, place[inner], a, b, length, gram))
                left += [(inner[order[x : x + k]], a, b) for x, k in zip(edge.tolist(), size.tolist(), strict=True)]
    k = 0
    while k < len(ready):
        held, total = [], 0
        while k < len(ready) and total < SORT_BYTES:
            own, low, high = ready[k]
            first, number = windows(own, low, high)
            held.append((own, first, number))
            total += int((number - 1 + length).sum())
            k += 1
        own, first, number = (np.concatenate(x) for x in zip(*held, strict=True))
        at, part, fresh = _taken(body, first, number - 1 + length)
        np.logical_or.at(later, at, repeats(part, fresh, doc[own], start[own] + first - begin[own], number, length))
    return later


def _sort(length: int, gram: int):
    def sort(table: pa.Table) -> pa.Table:
        """Of one range: which windows of each piece sent have an equal window at an earlier place."""
        read = lambda column, kind: [K.unpack(table.column(column)[i].as_py(), kind) for i in range(table.num_rows)]
        data = read("a", np.uint8)
        doc, start = (np.concatenate(read(c, np.int64)) for c in "bc")
        n, offset = (np.concatenate(read(c, np.int16)).astype(np.int64) for c in "df")
        core = np.concatenate([K.unpack_sorted(table.column("e")[i].as_py()) for i in range(table.num_rows)])
        size = n - 1 + length
        later = _later(np.concatenate(data), np.cumsum(size) - size, doc, start, n, offset, core, length, gram)
        ends = np.cumsum([len(x) for x in data])
        flags = [K.pack(np.packbits(later[a:b])) for a, b in zip(np.concatenate(([0], ends[:-1])), ends, strict=True)]
        return pa.table({"block": table.column("block"), "part": table.column("part"), "codes": pa.array(flags, pa.binary()), "step": pa.array([2] * len(flags), pa.int32())})

    return sort


def covered(size: int, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Bytes inside any of the ranges."""
    steps = np.bincount(begin, minlength=size + 1).astype(np.int32) - np.bincount(stop, minlength=size + 1).astype(np.int32)
    return np.cumsum(steps, dtype=np.int32)[:size] > 0


def _finish(parts: int, length: int, gram: int, kind: pa.DataType):
    def finish(key, texts: pa.Table, answers: pa.Table) -> pa.Table:
        table = K.thaw(texts.column("body")[0].as_py())
        ids, found = _ids(table), block_runs(table, length, gram)
        steps = np.array(answers.column("step").to_pylist(), np.int32)
        code = _codes(answers.filter(pa.array(steps == 1)))
        order, first, index = entries(ids, found)
        doc, start, n = found[2:5]
        body, at = B.raw(pa.concat_arrays(table.column(1).chunks))
        begin = at[doc] + start
        head = order[first[index]]
        gone = np.empty(len(order), bool)
        gone[order] = (ids[doc[order]] != ids[doc[head]]) | (start[order] != start[head]) | (code[index] == 1)
        lows, highs = [begin[gone]], [begin[gone] + n[gone] - 1 + length]
        core, run, piece, windows, _ = pieces(body, at, found, order[first][code == 2], length, gram)
        cut = K.cuts(core, parts)
        second = answers.filter(pa.array(steps == 2))
        flags = dict(zip(second.column("part").to_pylist(), second.column("codes").to_pylist(), strict=True))
        # all runs at the entry's place (repeated rows too) take the flags of the one that was sent
        same = {}
        for p, packed in flags.items():
            own = slice(cut[p], cut[p + 1])
            size = windows[own] - 1 + length
            later = np.flatnonzero(np.unpackbits(K.unpack(packed, np.uint8), count=int(size.sum())))
            offset = np.cumsum(size) - size
            which = np.searchsorted(offset, later, "right") - 1
            low = piece[own][which] + later - offset[which]
            lows.append(low)
            highs.append(low + length)
            for r, x in zip(run[own][which].tolist(), (low - begin[run[own][which]]).tolist(), strict=True):
                same.setdefault(r, []).append(x)
        twins = np.flatnonzero(~gone[order] & (code[index] == 2) & (order != head))
        for k in twins.tolist():
            for x in same.get(int(head[k]), ()):
                lows.append(np.array([begin[order[k]] + x]))
                highs.append(np.array([begin[order[k]] + x + length]))
        removed = covered(len(body), np.concatenate(lows), np.concatenate(highs))
        out: list[list] = [[], [], [], []]
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            mask = removed[a:b]
            edge = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
            out[0].append(b - a)
            out[1].append(int(mask.sum()))
            out[2].append([f"{x}:{y}" for x, y in edge.reshape(-1, 2).tolist()])
            out[3].append(hashlib.sha256(body[a:b][~mask].tobytes()).hexdigest())
        return pa.table({"doc_id": table.column(0).cast(kind), "n_bytes": pa.array(out[0], pa.int64()), "n_removed": pa.array(out[1], pa.int64()), "spans": pa.array(out[2], pa.list_(pa.string())), "kept_sha256": pa.array(out[3], pa.string())})

    return finish


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (removed byte ranges 'from:to') and kept_sha256 of every row."""
    from pyspark.sql.pandas.types import to_arrow_type

    field = docs.schema["doc_id"].dataType
    rows = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    packed = "part int, block bigint, a binary, b binary, c binary, d binary"
    texts = keep(rows.mapInArrow(K.frozen, K.FROZEN))
    parts = K.ranges(texts)
    codes = keep(texts.mapInArrow(_ask(parts, length, gram), packed).groupBy("part").applyInArrow(_judge, "block bigint, part int, codes binary"))
    segments = texts.groupBy("block").cogroup(codes.groupBy("block")).applyInArrow(_rest(parts, length, gram), packed + ", e binary, f binary")
    later = segments.groupBy("part").applyInArrow(_sort(length, gram), "block bigint, part int, codes binary, step int")
    answers = keep(codes.withColumn("step", F.lit(1)).unionByName(later))
    out = f"doc_id {field.simpleString()}, n_bytes bigint, n_removed bigint, spans array<string>, kept_sha256 string"
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_finish(parts, length, gram, to_arrow_type(field)), out)
