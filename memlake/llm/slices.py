"""Slices: runs of whole documents of about 2 MB in one row each, so that numpy can read a corpus in bounded pieces that have a name.

A slice is written once; later passes over it find the same documents under the same name, and answers can be sent to it by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from memlake.llm.common import cut

SLICE = 2 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def slices(docs: DataFrame, size: int = SLICE, **columns: Column) -> DataFrame:
    """docs: text and what ``columns`` ask for -> slice, text (UTF-8 bytes, a line feed after every document, null read as empty;
    compressed, ``rows_of`` undoes it), ends (where each document ends, its line feed included), and each of ``columns`` as an array with a
    value a document.

    A slice holds ``size`` bytes or one longer document. No documents: no slices."""
    rows = docs.select(F.concat(F.coalesce(F.col("text"), F.lit("")), F.lit("\n")).cast("binary").alias("text"), *[c.alias(k) for k, c in columns.items()])
    fields = [StructField("slice", LongType()), StructField("text", BinaryType()), StructField("ends", ArrayType(IntegerType()))]
    schema = StructType(fields + [StructField(k, ArrayType(rows.schema[k].dataType)) for k in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        for b in batches:
            text = b.column(0)
            offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
            at = 0
            while at < len(text):
                to = max(at + 1, int(np.searchsorted(offsets, int(offsets[at]) + size, "right")) - 1)
                data = pa.compress(text.buffers()[2].slice(int(offsets[at]), int(offsets[to] - offsets[at])), codec="zstd", asbytes=True)
                listed = [pa.array(offsets[at + 1 : to + 1] - offsets[at], pa.int32()), *[c.slice(at, to - at) for c in b.columns[1:]]]
                lists = [pa.ListArray.from_arrays(pa.array([0, to - at], pa.int32()), x) for x in listed]
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([data], pa.binary()), *lists], names=schema.names)
                name, at = name + 1, to

    return cut(rows.mapInArrow(run, schema))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows one by one, the text of a slice as folded bytes (A-Z lower-cased)."""
    for b in batches:
        for i in range(b.num_rows):
            row = b.slice(i, 1).to_pylist()[0]
            row["ends"] = np.asarray(row["ends"], np.int64)
            row["text"] = LOWER[np.frombuffer(pa.decompress(row["text"], int(row["ends"][-1]), codec="zstd"), np.uint8)]
            yield row


def kinds(*others: bytes) -> np.ndarray:
    """A table from byte to kind: 0 inside words; 1, 2, ... for the bytes of each of ``others``."""
    table = np.zeros(256, np.uint8)
    for k, chars in enumerate(others, 1):
        table[list(chars)] = k
    return table


def tokens(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes whose kind is 0."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = table[data] == 0
    edges = np.flatnonzero(np.diff(inside))
    return edges[0::2], edges[1::2]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the given spans one after another, and their offsets."""
    lens = ends - starts
    offsets = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=offsets[1:])
    return data[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lens)], offsets


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as an Arrow array of strings."""
    chars, offsets = gathered(data, starts, ends)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(chars)).cast(pa.string())


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int, block: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash for each span: the sum of its bytes weighted by place, mixed. Worked in blocks, so that memory stays small."""
    out = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return out
    weights = mix(np.arange(1, int((ends - starts).max()) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)
    bounds = [0, *np.flatnonzero(np.diff(starts // block)) + 1, len(starts)]
    for a, b in zip(bounds, bounds[1:], strict=False):
        chars, offsets = gathered(data, starts[a:b], ends[a:b])
        place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], np.diff(offsets))
        out[a:b] = np.add.reduceat((chars.astype(np.uint64) + np.uint64(1)) * weights[place], offsets[:-1])
    return mix(out)


def numbered(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for things known by two hashes (128 bits): the place of each number's first bearer, and the number of each thing."""
    _, first, number = np.unique(one, return_index=True, return_inverse=True)
    if len(one) and (two[first][number] != two).any():
        _, first, number = np.unique(np.stack([one, two]), axis=1, return_index=True, return_inverse=True)
    return first, number.reshape(-1)


def text_seeds(values: pa.Array, seed: int) -> np.ndarray:
    """A 64-bit hash for each string of a list, to tell the tokens of different groups apart."""
    data = [(v or "").encode() for v in values.to_pylist()]
    ends = np.cumsum([len(x) + 1 for x in data])
    joined = np.frombuffer(b"".join(x + b"\n" for x in data), np.uint8)
    return hashes(joined, np.concatenate([[0], ends[:-1]]), ends, seed) if data else np.zeros(0, np.uint64)
