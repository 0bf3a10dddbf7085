"""A positional inverted index: written once, partitioned by a hash of the term and ordered by term, so that a question reads the postings of its own terms only.

A row holds a term's postings in one piece of the chunks, so that what is shuffled and written is numbers and hardly any words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.search.analysis import words
from memlake.search.question import parse, score, terms_of

#: Folders of terms, chunks that are indexed together, and chunks that are scored together.
BUCKETS, PIECE, SCORED = 64, 2048, 256

POSTINGS = "term string, data_ids array<long>, ordinals array<int>, positions array<array<int>>"


def _bucket(term: Column) -> Column:
    return F.pmod(F.hash(term), F.lit(BUCKETS))


def _inverted(language: str):
    """Rows of ``POSTINGS``: for each term of a piece the chunks that hold it and its positions in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, PIECE):
                piece = b.slice(at, PIECE)
                listed = [words(x.as_py(), language) for x in piece.column(2)]
                named = sorted({t for x in listed for t in x if t})
                number = {t: i for i, t in enumerate(named)} | {None: -1}
                term = np.fromiter((number[t] for x in listed for t in x), np.int32)
                sizes = np.array([len(x) for x in listed])
                chunk = np.repeat(np.arange(len(listed)), sizes)
                place = np.arange(len(term)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
                order = np.argsort(term, kind="stable")[np.count_nonzero(term < 0) :]
                term, chunk = term[order], chunk[order]
                first = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(chunk, prepend=-1) != 0))
                here = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(place[order], pa.int32()))
                ends = pa.array(np.searchsorted(term[first], np.arange(len(named) + 1)), pa.int32())
                by_term = [pa.ListArray.from_arrays(ends, x) for x in (piece.column(0).take(pa.array(chunk[first])), piece.column(1).take(pa.array(chunk[first])), here)]
                yield pa.RecordBatch.from_arrays([pa.array(named, pa.string()), *by_term], names=["term", "data_ids", "ordinals", "positions"])

    return run


def write_postings(chunks: DataFrame, path: str, language: str = "english") -> DataFrame:
    """chunks: data_id, ordinal, chunk -> postings by bucket and term at ``path``. A term that a third of all chunks hold has a row for each
    piece of them, and those of a large bucket are spread over files, so that no task writes it whole."""
    rows = chunks.select(F.col("data_id").cast("long"), F.col("ordinal").cast("int"), "chunk").mapInArrow(_inverted(language), POSTINGS)
    rows.withColumn("bucket", _bucket(F.col("term"))).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)
    return read_postings(chunks.sparkSession, path)


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{POSTINGS}, bucket int").parquet(path)


def _answers(asked: dict):
    """data_id, ordinal, at (term, positions) -> the questions that a chunk answers, with their score. A question is only looked at in chunks that hold
    all terms that one of its alternatives wants; it is found by the longest of them."""
    needs: dict[str, list[tuple[str, frozenset[str]]]] = {}
    for name, question in asked.items():
        for a in question:
            need = frozenset(t for p in a.wanted for t, _ in p)
            needs.setdefault(max(sorted(need), key=len), []).append((name, need))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, SCORED):
                out = []
                for row in b.slice(start, SCORED).to_pylist():
                    at = {x["term"]: x["positions"] for x in row["at"]}
                    met = {name for t in at for name, need in needs.get(t, ()) if need <= at.keys()}
                    out += [(name, row["data_id"], row["ordinal"], s) for name in sorted(met) if (s := score(asked[name], at)) is not None]
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["question", "data_id", "ordinal", "score"])

    return run


def may_answer(questions: dict[str, str], language: str, text: Column) -> Column:
    """Whether a text holds, somewhere among its letters, all words that an alternative of one of a few questions wants: without a look at its terms,
    no text that is left out has a chunk that answers. Where words are stemmed, and for words beyond a-z and 0-9, whose lower case may depend
    on what stands beside them, nothing is left out."""
    if language != "simple":
        return F.lit(True)
    wanted = {frozenset(t for p in a.wanted for t, _ in p if t.isascii()) for q in questions.values() for a in parse(q, language)}
    holds = [reduce(Column.__and__, [F.contains(F.lower(text), F.lit(t)) for t in sorted(need)], F.lit(True)) for need in sorted(wanted, key=sorted)]
    return reduce(Column.__or__, holds, F.lit(False))


def search(postings: DataFrame, questions: dict[str, str], k: int, language: str = "english", allowed: DataFrame | None = None) -> DataFrame:
    """question, data_id, ordinal, score, rank: for each question (named) its k best chunks by cover density; ties by record and ordinal.

    allowed: data_id of the records that may be read, applied before the cut. Partitions and row groups without a term of the questions are not
    read. A chunk's postings meet once, for all questions together: a word that many questions share is sent once a chunk. A question none
    of whose alternatives wants a word has no answers, as no posting leads to them."""
    spark = postings.sparkSession
    asked = {name: parse(text, language) for name, text in questions.items()}
    terms = sorted({t for q in asked.values() for t in terms_of(q)})
    buckets = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket(F.col("term"))).distinct().collect()]
    own = postings.where(F.col("bucket").isin(*buckets) & F.col("term").isin(*terms)) if terms else postings.where(F.lit(False))
    own = own.select("term", F.explode(F.arrays_zip("data_ids", "ordinals", "positions")).alias("p")).select("term", F.col("p.data_ids").alias("data_id"), F.col("p.ordinals").alias("ordinal"), "p.positions")
    if allowed is not None:
        own = own.join(allowed.select("data_id"), "data_id", "left_semi")
    met = own.groupBy("data_id", "ordinal").agg(F.collect_list(F.struct("term", "positions")).alias("at"))
    found = met.mapInArrow(_answers(asked), "question string, data_id long, ordinal int, score double")
    ranked = found.withColumn("score", F.round("score", 6))
    order = Window.partitionBy("question").orderBy(F.desc("score"), "data_id", "ordinal")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
