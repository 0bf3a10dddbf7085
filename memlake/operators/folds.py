"""Ordered folds: what a row does depends on what the rows before it left behind."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def folded(rows: DataFrame, key: str, order: list[str], start: Callable, step: Callable[[object, dict], tuple[object, Iterable[tuple]]], finish: Callable[[object], Iterable[tuple]], schema: str) -> DataFrame:
    """Folds the rows of each key in order. ``start(key)`` gives the first state, ``step(state, row)`` the next one and what a row puts out,
    ``finish(state)`` what is left to put out; ``schema`` describes that.

    Spark shuffles by key and sorts within partitions, spilling where it must; a task then reads its rows in batches and holds one state. A
    key's rows are never together in memory, so a key with a third of all rows takes time and not space. Null keys are a key."""
    out = rows.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, held, state = to_arrow_schema(out), [], None
        for b in batches:
            found: list[tuple] = []
            for row in b.to_pylist():
                if not held or held[0] != row[key]:
                    if held:
                        found += finish(state)
                    held, state = [row[key]], start(row[key])
                state, made = step(state, row)
                found += made
            yield _batch(found, arrow)
        if held:
            yield _batch(list(finish(state)), arrow)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, StructType(out.fields))


def _batch(found: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*found, strict=True) if found else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
