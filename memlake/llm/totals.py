"""Exact totals over a corpus for the keys of each slice: asked and answered in blocks of hash values.

A slice sends each of its keys once, whatever its number of occurrences, so no key weighs more than the number of slices, and blocks of
hash values are even. A key is known by 96 bits of two hashes. The answer to a slice lists totals in the order in which it asked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from memlake.llm.slices import numbered

ASKED = "slice long, block long, one binary, two binary, counts binary"
_ASKED = pa.schema([("slice", pa.int64()), ("block", pa.int64()), ("one", pa.binary()), ("two", pa.binary()), ("counts", pa.binary())])
_ANSWER = pa.schema([("slice", pa.int64()), ("block", pa.int64()), ("totals", pa.binary()), ("distinct", pa.int64()), ("total", pa.int64())])


def ask(name: int, one: np.ndarray, two: np.ndarray, counts: np.ndarray, blocks: int) -> Iterator[pa.RecordBatch]:
    """one, two: two hashes of each key, distinct, in the order of the first."""
    if not len(one):
        return
    block = ((one >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
    bounds = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(one)]
    spans = list(zip(bounds, bounds[1:], strict=False))
    short = two.astype(np.uint32)
    packed = [[x[a:b].tobytes() for a, b in spans] for x in (one, short, counts.astype(np.uint32))]
    yield pa.RecordBatch.from_arrays([pa.array([name] * len(spans), pa.int64()), pa.array([int(block[a]) for a, _ in spans], pa.int64()), *[pa.array(x, pa.binary()) for x in packed]], schema=_ASKED)


def answered(asked: DataFrame) -> DataFrame:
    """asked: what ``ask`` yields -> slice, block, totals (64-bit, one for each key sent); on one row of each block also distinct, the number
    of its keys whose total is not 0, and total, their sum; 0 elsewhere."""

    def add(group: pa.Table) -> pa.Table:
        one, two, counts = (np.concatenate([np.frombuffer(x, kind) for x in group.column(c).to_pylist()]) for c, kind in (("one", np.uint64), ("two", np.uint32), ("counts", np.uint32)))
        first, number = numbered(one, two.astype(np.uint64))
        sums = np.zeros(len(first), np.int64)
        np.add.at(sums, number, counts)
        ends = np.cumsum([len(x) // 4 for x in group.column("counts").to_pylist()])
        back = [x.tobytes() for x in np.split(sums[number], ends[:-1])]
        once = lambda n: pa.array([int(n)] + [0] * (len(back) - 1), pa.int64())
        return pa.Table.from_arrays([group.column("slice"), group.column("block"), pa.array(back, pa.binary()), once((sums > 0).sum()), once(sums.sum())], schema=_ANSWER)

    return asked.groupBy("block").applyInArrow(add, "slice long, block long, totals binary, distinct long, total long")


def totals_of(answer: list[dict] | None) -> np.ndarray:
    """The answer to a slice, in the order of its keys."""
    return np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(x["totals"], np.int64) for x in sorted(answer or [], key=lambda x: x["block"])]])
