"""Vectorised hashing of words and byte windows over the buffers of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Text handled at once, in bytes; one document is never cut.
AT_ONCE = 256 << 10
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(1)
def _byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * U(_BASE))


def _made(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n + 1, _BASE, np.uint64)
    down = np.full(n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    return _made(AT_ONCE * 2)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rising powers of the base and of its inverse, n at least; those of one long text aren't held on to."""
    return _powers() if n <= AT_ONCE * 2 else _made(n)


def small_batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most AT_ONCE bytes of text each, or one row."""
    for batch in batches:
        texts = batch.column(column)
        ends = raw(texts)[1][1:]
        start = 0
        while start < len(texts):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + AT_ONCE, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its n + 1 offsets into them; nulls are empty."""
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    width = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    at = np.frombuffer(offsets, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return body, at - at[0]


def prefix(body: np.ndarray) -> np.ndarray:
    """Running polynomial sums; hash_range() takes differences of them."""
    up, _ = powers(len(body))
    out = np.zeros(len(body) + 1, np.uint64)
    np.cumsum(_byte_codes()[body] * up[: len(body)], out=out[1:])
    return out


def hash_range(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range [start, stop)."""
    _, down = powers(len(sums) - 1)
    return mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def word_ranges(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops of the words, and for each document the index of its first word (n + 1 values)."""
    if not len(body):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inner = ~SPACES[body]
    first = np.zeros(len(body) + 1, bool)
    first[at] = True
    starts = np.flatnonzero(inner & np.concatenate(([True], ~inner[:-1])) | inner & first[:-1])
    stops = np.flatnonzero(inner & (np.concatenate((~inner[1:], [True])) | first[1:])) + 1
    return starts, stops, np.searchsorted(starts, at)


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and for each document the index of its first word (n + 1 values)."""
    body, at = raw(texts)
    if lower:
        body = LOWER[body]
    starts, stops, first = word_ranges(body, at)
    return hash_range(prefix(body), starts, stops), first


def ngrams(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each n consecutive words of a document."""
    docs = np.repeat(np.arange(len(first) - 1), np.diff(first))
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    own = docs[: len(words) - n + 1] == docs[n - 1 :]
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = mix(out * U(0x9FB21C651E98DF25) + words[k : k + len(out)])
    return out[own], docs[: len(out)][own]


def uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1), from hashes."""
    return ((x >> U(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))
