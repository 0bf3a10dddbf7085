"""Count-min sketches that are as wide as the input asks for: merged block by block, and asked slice by slice.

A sketch that one task can hold is too narrow for a large corpus, where its cells fill up and rule nothing out. Here the width is in
proportion to what is counted, and no task ever holds more than one block of it. A slice sends the cells that it touches; a block adds up
what all slices send to it; each slice gets back a bit for each of its own cells, in order: whether its sum reaches the threshold. A slice names a cell once
whatever the number of occurrences behind it, and cells are spread by hash, so that blocks are even however skewed the counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.slices import mix

#: Rows of the sketch, and the bits of a cell's number inside its block.
ROWS, BITS = 2, 20
SENT = "slice long, sketch int, block long, size int, cells binary"
_SENT = pa.schema([("slice", pa.int64()), ("sketch", pa.int32()), ("block", pa.int64()), ("size", pa.int32()), ("cells", pa.binary())])


def _packed(cells: np.ndarray, counts: np.ndarray) -> bytes:
    """Ordered cells of a block and their counts: gaps between cells in two planes, of which the higher is mostly zero, compressed."""
    gaps = np.diff(cells, prepend=cells.dtype.type(0))
    return pa.compress((gaps & 255).astype(np.uint8).tobytes() + (gaps >> 8).astype(np.uint16).tobytes() + counts.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, size: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    raw = pa.decompress(data, size * (3 + np.dtype(kind).itemsize), codec="zstd", asbytes=True)
    gaps = np.frombuffer(raw, np.uint8, size).astype(np.int64) + (np.frombuffer(raw, np.uint16, size, size).astype(np.int64) << 8)
    return np.cumsum(gaps), np.frombuffer(raw, kind, size, 3 * size)


def blocks_for(items: int, cells: float) -> int:
    """The number of blocks that gives about ``cells`` cells for each item counted."""
    return int(items * cells) // (1 << BITS) + 1


def cells_of(keys: np.ndarray, row: int, blocks: int) -> np.ndarray:
    m = mix(keys + np.uint64((row + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1))
    return ((m >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32) << np.uint64(BITS)) | (m & np.uint64((1 << BITS) - 1))


def _summed(cells: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells in order and their sums, both sums and counts no higher than ``least``, as no more is asked of them."""
    bits = least.bit_length()
    if bits <= 12:
        packed = np.sort((cells << np.uint64(bits)) | np.minimum(counts, least).astype(np.uint64))
        cells, counts = packed >> np.uint64(bits), (packed & np.uint64((1 << bits) - 1)).astype(np.int64)
    else:
        order = np.argsort(cells)
        cells, counts = cells[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    return cells[first], np.minimum(np.add.reduceat(counts, first), least)


def sketch(name: int, keys: np.ndarray, counts: np.ndarray, blocks: int, least: int, number: int = 0) -> Iterator[pa.RecordBatch]:
    """What the slice ``name`` sends to the sketch ``number``: for each row and block, the gaps between its cells and their counts."""
    if not len(keys):
        return
    out: list[list] = [[], [], [], [], []]
    for row in range(ROWS * number, ROWS * (number + 1)):
        cells, sums = _summed(cells_of(keys, row, blocks), counts, least)
        block = (cells >> np.uint64(BITS)).astype(np.int64)
        bounds = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(cells)]
        inside = (cells & np.uint64((1 << BITS) - 1)).astype(np.int64)
        for a, b in zip(bounds, bounds[1:], strict=False):
            for column, value in zip(out, (name, row, int(block[a]), b - a, _packed(inside[a:b], sums[a:b].astype(np.uint8 if least < 256 else np.uint32))), strict=True):
                column.append(value)
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _SENT, strict=True)], schema=_SENT)


def answers(sent: DataFrame, least: int) -> DataFrame:
    """sent: what ``sketch`` yields -> the same columns, with a bit for each cell sent in place of the cells: whether its merged count is at
    least ``least``. Blocks without a hot cell send no answer."""
    kind = np.uint8 if least < 256 else np.uint32

    def merge(group: pa.Table) -> pa.Table:
        total = np.zeros(1 << BITS, np.int64)
        sent = list(zip(group.column("cells").to_pylist(), group.column("size").to_pylist(), strict=True))
        for data, size in sent:
            cells, counts = _unpacked(data, size, kind)
            total[cells] += counts
        hot = [total[_unpacked(data, size, kind)[0]] >= least for data, size in sent]
        bits = [pa.compress(np.packbits(x).tobytes(), codec="zstd", asbytes=True) if x.any() else None for x in hot]
        return pa.Table.from_arrays([*(group.column(c) for c in ("slice", "sketch", "block", "size")), pa.array(bits, pa.binary())], schema=_SENT)

    merged = sent.groupBy("sketch", "block").applyInArrow(merge, SENT)
    return merged.where("cells is not null")


def by_slice(hot: DataFrame) -> DataFrame:
    """Answers, of one sketch or several -> slice, hot: the list of a slice's answers."""
    return hot.groupBy("slice").agg(F.collect_list(F.struct("sketch", "block", "size", "cells")).alias("hot"))


def hot_cells(hot: list[dict] | None, keys: np.ndarray, blocks: int, number: int = 0) -> list[np.ndarray]:
    """The answer of the sketch ``number`` to a slice that sent ``keys`` (in any order, with or without repeats), as sorted cells of each row."""
    out = []
    for row in range(ROWS * number, ROWS * (number + 1)):
        cells = np.sort(cells_of(keys, row, blocks))
        cells = cells[np.concatenate([[True], cells[1:] != cells[:-1]])] if len(cells) else cells
        bits = np.zeros(len(cells), bool)
        for x in (x for x in hot or [] if x["sketch"] == row):
            a, b = np.searchsorted(cells, np.array([x["block"], x["block"] + 1], np.uint64) << np.uint64(BITS))
            raw = pa.decompress(x["cells"], (x["size"] + 7) // 8, codec="zstd", asbytes=True)
            bits[a:b] = np.unpackbits(np.frombuffer(raw, np.uint8), count=x["size"])
        out.append(cells[bits])
    return out


def may_reach(keys: np.ndarray, hot: list[np.ndarray], blocks: int, number: int = 0) -> np.ndarray:
    """Which keys may have reached the threshold in the sketch ``number``: those whose cell is hot in every row. Never false for one that has."""
    out = np.ones(len(keys), bool)
    for row, cells in enumerate(hot, ROWS * number):
        mine = cells_of(keys, row, blocks)
        at = np.minimum(np.searchsorted(cells, mine), max(len(cells) - 1, 0))
        out &= cells[at] == mine if len(cells) else False
    return out
