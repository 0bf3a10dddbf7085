"""Chunks with exact character spans, and the local hash embedder."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What parts paragraphs, and characters of chunks that leave a task together.
_BREAK = re.compile(r"\n\s*\n")
PIECE = 1 << 20


def paragraphs(text: str) -> list[tuple[int, int]]:
    """Spans between the breaks, breaks left out; the whole text if there is nothing else."""
    breaks = [m.span() for m in _BREAK.finditer(text)]
    edges = zip([0, *[b for _, b in breaks]], [*[a for a, _ in breaks], len(text)], strict=True)
    return [(a, b) for a, b in edges if b > a] or [(0, len(text))]


def windows(a: int, b: int, most: int, overlap: int) -> list[tuple[int, int]]:
    step = most - overlap if most > overlap else most
    count = 1 + max(0, -(-(b - a - most) // step))
    return [(a + i * step, min(a + i * step + most, b)) for i in range(count)]


def spans(text: str, most: int = 1200, overlap: int = 150) -> list[tuple[int, int]]:
    """Paragraphs packed while a chunk, from the first one's start to the last one's end, stays within ``most`` characters; a longer
    paragraph is cut into windows that overlap; blank chunks are left out. Spans count code points."""
    out: list[tuple[int, int]] = []
    open_ = False
    for a, b in paragraphs(text):
        if b - a > most:
            out += windows(a, b, most, overlap)
            open_ = False
        elif open_ and b - out[-1][0] <= most:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
            open_ = True
    return [(a, b) for a, b in out if text[a:b].strip()]


def chunks(texts: DataFrame, most: int = 1200, overlap: int = 150) -> DataFrame:
    """data_id, text -> data_id, ordinal, span_start, span_end, chunk. Texts are read one by one, and chunks leave a task a ``PIECE`` at a time."""
    key = texts.schema["data_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held = [], 0

            def taken(b=b):
                of, *rest = zip(*rows, strict=True)
                columns = [b.column(0).take(pa.array(of)), *[pa.array(x, k) for x, k in zip(rest, (pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)]]
                return pa.RecordBatch.from_arrays(columns, names=["data_id", "ordinal", "span_start", "span_end", "chunk"])

            for i in range(b.num_rows):
                text = b.column(1)[i].as_py()
                for ordinal, (a, z) in enumerate(spans(text, most, overlap) if text else []):
                    rows.append((i, ordinal, a, z, text[a:z]))
                    held += z - a
                    if held > PIECE:
                        yield taken()
                        rows, held = [], 0
            if rows:
                yield taken()

    return texts.select("data_id", "text").mapInArrow(run, f"data_id {key}, ordinal int, span_start int, span_end int, chunk string")


def hash_embedding(text: str | None, dim: int) -> np.ndarray:
    """Signed counts of hashed tokens, length one. The first four bytes of a token's digest choose the place, the low bit of the fifth
    the sign; a text without tokens, or whose tokens cancel out, points along the first axis."""
    v = np.zeros(dim)
    for token in re.findall(r"[a-z0-9]+", (text or "").lower()):
        h = hashlib.blake2b(token.encode(), digest_size=8).digest()
        v[int.from_bytes(h[:4], "big") % dim] += 1.0 if h[4] % 2 else -1.0
    n = np.linalg.norm(v)
    if not n:
        v[0] = n = 1.0
    return v / n


def hash_embed(text: Column, dim: int = 64) -> Column:
    @F.pandas_udf("array<float>")
    def embed(t: pd.Series) -> pd.Series:
        return pd.Series([hash_embedding(x, dim).astype(np.float32) for x in t])

    return embed(text)
