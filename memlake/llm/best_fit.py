"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted. Texts longer than the longest are cut into full pieces and a rest. Pieces are dealt by a
hash into shards of about SHARD pieces, so that packing is spread over tasks of bounded size whatever the corpus. In a shard,
pieces go longest first into the open bin they fill best; where none fits, the bin size of least cost is opened: the size
(plus a fixed cost for each sequence) for each token that it would hold once the remaining pieces have filled it greedily.
At the end each bin is downsized to the shortest permitted length that holds its contents.

Tokens are counted as white-space separated words unless a count column is given. Defined results: documents without tokens
(null, empty, negative counts) take no room and get no row; equal pieces are ordered by id and piece; repeated rows are packed
each; a null id is packed like any other; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import cut

LENGTHS = (512, 1024, 2048, 4096)
SHARD = 8192
OVERHEAD = 16


def word_count(text: str) -> Column:
    """Number of runs of characters other than space and \\x09-\\x0D."""
    return F.coalesce(F.size(F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def _greedy_fill(room: int, sizes: list[int], left: Counter) -> int:
    """Tokens that the remaining sizes (ascending, with counts) put into ``room``, largest first."""
    used, at = 0, len(sizes)
    while room > 0 and (at := bisect_right(sizes, room, 0, at)):
        size = sizes[at - 1]
        take = min(left[size], room // size)
        used += take * size
        room -= take * size
        at -= 1
    return used


def pack(pieces: list[int], lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> list[tuple[int, int, int]]:
    """For each piece, in the given order (longest first): (bin, offset). Third: the bin's final length."""
    left = Counter(pieces)
    sizes = sorted(left)
    rooms: list[tuple[int, int]] = []  # (free, bin), ascending
    filled: list[int] = []
    placed = []
    for size in pieces:
        left[size] -= 1
        if not left[size]:
            sizes.pop(bisect_left(sizes, size))
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            free, b = rooms.pop(at)
        else:
            cost = lambda c: (c + overhead) / (size + _greedy_fill(c - size, sizes, left))  # noqa: B023, E731
            free = min((c for c in lengths if c >= size), key=lambda c: (cost(c), -c))
            b = len(filled)
            filled.append(0)
        placed.append((b, filled[b]))
        filled[b] += size
        if free > size:
            insort(rooms, (free - size, b))
    final = [min(c for c in lengths if c >= f) for f in filled]
    return [(b, offset, final[b]) for b, offset in placed]


def best_fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None, lengths: tuple[int, ...] = LENGTHS, shard: int = SHARD, overhead: int = OVERHEAD) -> DataFrame:
    """One row per piece: doc_id, copy (from 1, for repeated rows), piece (from 0), n_tokens, shard, bin, bin_length, bin_offset. Only ids and counts are moved."""
    lengths = tuple(sorted(lengths))
    top = lengths[-1]
    counted = docs.select(F.col(id_col).alias("doc_id"), (F.col(count_col).cast("long") if count_col else word_count(text_col)).alias("tokens")).where("tokens > 0")
    kind = dict(counted.dtypes)["doc_id"]
    copies = counted.groupBy("doc_id", "tokens").agg(F.count("*").alias("copies")).select("doc_id", "tokens", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    pieces = copies.select("doc_id", "copy", "tokens", F.explode(F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / top).cast("int"))).alias("piece"))
    pieces = pieces.select("doc_id", "copy", "piece", F.least(F.lit(top), F.col("tokens") - F.col("piece").cast("long") * top).cast("int").alias("n_tokens"))
    pieces = cut(pieces)
    total = pieces.count()
    shards = max(1, -(-total // shard))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "copy", "piece", "n_tokens"), F.lit(shards)).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "copy", "piece"], ascending=[False, True, True, True], kind="stable")
        placed = pack(pdf.n_tokens.tolist(), lengths, overhead)
        return pdf.assign(bin=[p[0] for p in placed], bin_length=[p[2] for p in placed], bin_offset=[p[1] for p in placed])[["doc_id", "copy", "piece", "n_tokens", "shard", "bin", "bin_length", "bin_offset"]]

    return dealt.groupBy("shard").applyInPandas(run, f"doc_id {kind}, copy long, piece int, n_tokens int, shard int, bin int, bin_length int, bin_offset int")
