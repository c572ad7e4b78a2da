"""Byte-level BPE by segment trees of pair ranks, and its decoding.

A text is split by the tokenizer's pattern; each piece is encoded separately. A piece that is a token
is that token. Any other piece has a segment tree over its byte positions: leaf i holds the rank of the
token that position i and the next live position would make, an inner node the leftmost least of its
children, as rank * width + position. The root names the next merge; a merge changes three leaves
(the merged pair's, that of the position taken in, and that of the live neighbour before), each a
walk to the root. So a piece of n bytes costs n log n steps, however long it is.

Short pieces are encoded many at a time, a row of one array a tree; pieces over LONG bytes one by one.
Pieces already seen are remembered, up to about MEMO of them a worker, which changes no result. Tasks hold
one batch of texts and their tokens; nothing is shuffled. The vocabulary (a file of fixed size, read by
the driver from the path given) is broadcast.

Null and empty texts have no tokens. Bytes that aren't UTF-8 are encoded as they stand and come back
as they were. Very long texts are split and encoded whole, a bounded number of pieces at a time.
Repeated rows give repeated results; ties between pairs go to the leftmost; extra columns are ignored
but those named in `carry`; an empty table gives an empty one. A vocabulary must hold all 256 single
bytes. decode() raises for an id that isn't in it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge.session import ship

#: Pieces of more bytes are encoded by themselves.
LONG = 128
#: Pieces remembered by a worker.
MEMO = 400_000
#: Pieces of a text handled at once.
AT_ONCE = 50_000
NONE = np.iinfo(np.int64).max


class Vocabulary:
    """Ranks of tokens, and the rank that each two adjacent tokens make, from the lines of a rank file."""

    def __init__(self, lines: bytes) -> None:
        self.rank: dict[bytes, int] = {}
        for line in lines.splitlines():
            if line.strip():
                token, rank = line.split()
                self.rank[base64.b64decode(token)] = int(rank)
        if any(bytes([b]) not in self.rank for b in range(256)):
            raise ValueError("the vocabulary must hold every single byte")
        rank = self.rank
        self.token = {r: t for t, r in rank.items()}
        #: (left id, right id) as one number: what they make
        self.pairs = {(rank[t[:k]] << 32) | rank[t[k:]]: r for t, r in rank.items() for k in range(1, len(t)) if t[:k] in rank and t[k:] in rank}
        keys = np.fromiter(self.pairs, np.int64, len(self.pairs))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], NONE)  # a last one that no pair has, so that places can't pass the end
        self.made = np.append(np.fromiter(self.pairs.values(), np.int64, len(keys))[order], -1)
        self.single = np.array([rank[bytes([b])] for b in range(256)], np.int64)

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each two tokens make, or -1."""
        pair = (left << 32) | right
        at = np.searchsorted(self.keys, pair)
        return np.where(self.keys[at] == pair, self.made[at], -1)


@lru_cache(2)
def vocabulary(lines: bytes) -> Vocabulary:
    return Vocabulary(lines)


def _set(tree: np.ndarray, width: int, root: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
    """One leaf of each of some trees, and the nodes above it; root: where each tree begins."""
    node = leaf + width
    tree[root + node] = value
    while width > 1:
        pair = root + (node & ~1)
        value = np.minimum(tree[pair], tree[pair + 1])
        node = node >> 1
        tree[root + node] = value
        width >>= 1


def merge_many(pieces: list[bytes], width: int, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """All ids of pieces of 2 to `width` bytes, and the number of each piece's; one merge in every piece a round.

    width is a power of two. A piece has a row of `width` places and one more, which stands for no place.
    """
    n, room = len(pieces), width + 1
    size = np.fromiter(map(len, pieces), np.int64, n)
    body = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(n, width)
    place = np.arange(room)
    ids = np.full((n, room), -1)
    ids[:, :width] = np.where(place[:width] < size[:, None], v.single[body], -1)
    grid = np.full((n, 2 * width), NONE)
    rank = v.join(ids[:, : width - 1].ravel(), ids[:, 1:width].ravel()).reshape(n, width - 1)
    grid[:, width : 2 * width - 1] = np.where((rank >= 0) & (place[1:width] < size[:, None]), rank * width + place[: width - 1], NONE)
    for level in range(width.bit_length() - 2, -1, -1):
        a = 1 << level
        grid[:, a : 2 * a] = np.minimum(grid[:, 2 * a : 4 * a : 2], grid[:, 2 * a + 1 : 4 * a : 2])
    ids, tree = ids.ravel(), grid.ravel()
    after = np.where(place + 1 < size[:, None], place + 1, width).ravel()  # the next live place
    before = np.broadcast_to(place - 1, (n, room)).ravel().copy()
    live = np.arange(n)
    while True:
        least = tree[live * 2 * width + 1]
        live, least = live[least != NONE], least[least != NONE]
        if not len(live):
            found = ids.reshape(n, room) >= 0
            return ids[found.ravel()], found.sum(1)
        row, root = live * room, live * 2 * width
        i, made = least % width, least // width
        j = after[row + i]
        k = after[row + j]  # the place after the one that is taken in
        ids[row + i], ids[row + j] = made, -1
        after[row + i], before[row + k] = k, i
        _set(tree, width, root, j, np.full(len(live), NONE))
        follow = v.join(made, ids[row + k])
        _set(tree, width, root, i, np.where(follow >= 0, follow * width + i, NONE))
        h = before[row + i]
        some = h >= 0
        h, row, root, made = h[some], row[some], root[some], made[some]
        lead = v.join(ids[row + h], made)
        _set(tree, width, root, h, np.where(lead >= 0, lead * width + h, NONE))


def merge_one(piece: bytes, v: Vocabulary) -> np.ndarray:
    """The ids of one piece of any length."""
    n = len(piece)
    width = 1 << (n - 1).bit_length()
    ids = v.single[np.frombuffer(piece, np.uint8)].tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    none, join = int(NONE), v.pairs.get
    first = v.join(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64))
    level = np.full(width, NONE)
    level[: n - 1] = np.where(first >= 0, first * width + np.arange(n - 1), NONE)
    levels = [level]
    while len(level) > 1:
        level = np.minimum(level[::2], level[1::2])
        levels.append(level)
    tree = [none] + np.concatenate(levels[::-1]).tolist()

    def put(leaf: int, value: int) -> None:
        node = leaf + width
        tree[node] = value
        while node > 1:
            node >>= 1
            least = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == least:
                return
            tree[node] = least

    while tree[1] != none:
        made, i = divmod(tree[1], width)
        j = after[i]
        k = after[j]
        ids[i], ids[j], after[i] = made, -1, k
        put(j, none)
        follow = None
        if k < n:
            before[k] = i
            follow = join((made << 32) | ids[k])
        put(i, none if follow is None else follow * width + i)
        h = before[i]
        if h >= 0:
            lead = join((ids[h] << 32) | made)
            put(h, none if lead is None else lead * width + h)
    return np.array([x for x in ids if x >= 0], np.int64)


class Encoder:
    """Encodes texts; remembers pieces from call to call."""

    def __init__(self, v: Vocabulary, pattern: str) -> None:
        self.v, self.pattern, self.memo = v, regex.compile(pattern), {}

    def pieces(self, text: str) -> Iterator[list[str]]:
        if len(text) <= AT_ONCE:
            yield self.pattern.findall(text)
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while some := list(islice(found, AT_ONCE)):
            yield some

    def learn(self, pieces: set[str]) -> list[str]:
        """Puts the ids of each piece, packed, into memo; returns those too long to stay there."""
        memo, groups, long = self.memo, {}, []
        for p in pieces:
            b = p.encode("utf-8", "surrogateescape")
            if (r := self.v.rank.get(b)) is not None:
                memo[p] = r.to_bytes(4, "little")
            elif len(b) > LONG:
                memo[p] = merge_one(b, self.v).astype("<u4").tobytes()
                long.append(p)
            else:
                own = groups.setdefault(1 << (len(b) - 1).bit_length(), ([], []))
                own[0].append(p)
                own[1].append(b)
        for width, (names, own) in groups.items():
            for k in range(0, len(own), 4096):
                ids, sizes = merge_many(own[k : k + 4096], width, self.v)
                packed, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
                memo.update(zip(names[k : k + 4096], [packed[a:b] for a, b in zip([0, *ends], ends)]))
        return long

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Of each text its ids, little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size, memo = 0, self.memo

        def flush() -> None:
            nonlocal size
            long = self.learn(set().union(*(own for _, own in held)) - memo.keys())
            for at, own in held:
                out[at].append(b"".join(map(memo.__getitem__, own)))
            for p in long:
                del memo[p]
            if len(memo) > MEMO:
                memo.clear()
            held.clear()
            size = 0

        for at, text in enumerate(texts):
            if text:
                for own in self.pieces(text.decode("utf-8", "surrogateescape")):
                    held.append((at, own))
                    size += len(own)
                    if size >= AT_ONCE:
                        flush()
        if held:
            flush()
        return [b"".join(x) for x in out]


_ENCODERS: dict[tuple[int, str], Encoder] = {}


def _encoder(lines: bytes, pattern: str) -> Encoder:
    key = (hash(lines), pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary(lines), pattern)
    return _ENCODERS[key]


def load(spark: SparkSession, path: str) -> Broadcast:
    """A rank file (a base64 token and its rank a line) that the driver reads, for all executors."""
    ship(spark)
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, ranks: Broadcast, pattern: str, *carry: str) -> DataFrame:
    """carry columns, n_tokens and ids (binary: little-endian unsigned 32-bit integers) of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(ranks.value, pattern)
        for batch in batches:
            ids = own.encode(batch.column(batch.num_columns - 1).to_pylist())
            made = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*batch.schema.names[:-1], "n_tokens", "ids"])

    rows = docs.select(*[F.col(f"`{c}`") for c in carry], F.col("text").cast("binary").alias("_tf_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}{', ' if kinds else ''}n_tokens bigint, ids binary")


def decode(tokens: DataFrame, ranks: Broadcast) -> DataFrame:
    """tokens (with the column ids of encode) and decoded, the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = vocabulary(ranks.value).token.__getitem__
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            made = [b"".join(map(token, np.frombuffer(x.as_py() or b"", "<u4").tolist())) for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], [*batch.schema.names, "decoded"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields)
    return tokens.mapInArrow(run, f"{kinds}, decoded binary")
