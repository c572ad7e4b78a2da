"""Exchange of counts between blocks of documents and ranges of hashes, packed to a few large rows.

A block is a bounded run of documents. It sends each range of the hash space one row with its
sorted distinct hashes and what belongs to them; a range's answers come back in the same order.
Packing keeps millions of tiny shuffle rows out of the JVM; sorted hashes are stored as
differences, byte planes apart, compressed. There are at least as many ranges as shuffle partitions,
and one for every RANGE_BYTES of text, so a range's rows fit a worker at any size of the input; a
block sends at most one row a range and never more rows than it has hashes, so rows grow with the
input at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termforge.llm import _bytes as B

BLOCK_BYTES = 4 << 20
RANGE_BYTES = 64 << 20


def pack(values: np.ndarray) -> bytes:
    """Integers or bytes, planes of bytes apart."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T if len(values) else np.zeros((1, 0), np.uint8)
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack(data: bytes, kind: type = np.uint64) -> np.ndarray:
    plain = np.frombuffer(zstandard.decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(plain.reshape(width, len(plain) // width).T).view(kind).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def cuts(values: np.ndarray, parts: int) -> np.ndarray:
    """Where sorted hashes pass from one of `parts` equal ranges to the next; parts + 1 indices."""
    edges = np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)
    return np.concatenate(([0], np.searchsorted(values, edges), [len(values)]))


def blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, pa.Table]]:
    """(block number, rows) with about BLOCK_BYTES of text each; numbers are unique over the tasks of a stage."""
    context = TaskContext.get()
    base, held, size, n = (context.partitionId() if context else 0) << 24, [], 0, 0
    for batch in B.small_batches(batches, column):
        held.append(batch)
        size += int(B.raw(batch.column(column))[1][-1])
        if size >= BLOCK_BYTES:
            yield base + n, pa.Table.from_batches(held)
            held, size, n = [], 0, n + 1
    if held:
        yield base + n, pa.Table.from_batches(held)


def freeze(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return zstandard.compress(sink.getvalue().to_pybytes(), 3)


def thaw(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.decompress(data)).read_all()


def frozen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (block, body, size), the rows of each block with the text in column 1, and its bytes of text."""
    for number, table in blocks(batches, 1):
        size = sum(int(B.raw(c)[1][-1]) for c in table.column(1).chunks)
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([freeze(table)], pa.binary()), pa.array([size], pa.int64())], FROZEN_NAMES)


FROZEN = "block bigint, body binary, size bigint"
FROZEN_NAMES = ["block", "body", "size"]


def ranges(texts: DataFrame) -> int:
    """Number of ranges for a written table of frozen blocks; only its sizes are read."""
    total = texts.agg(F.sum("size").alias("n")).first()["n"] or 0
    return max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES))


def thawed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.column(0)[k].as_py(), thaw(batch.column(1)[k].as_py())
