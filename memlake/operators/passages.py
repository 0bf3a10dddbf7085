"""Retrieval of passages: arms over chunks, their fusion, the trace of a search, and an answer whose markers are checked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators.retrieval import RRF_K, cosine, ranked

KEY = ("data_id", "ordinal")


def vector_passages(vectors: DataFrame, probe: list[float], k: int) -> DataFrame:
    """vectors: data_id, ordinal, vector (one model, access applied) -> data_id, ordinal, score, rank."""
    scored = vectors.select(*KEY, F.round(cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in probe])), 6).alias("score"))
    return ranked(scored, k, F.desc("score"), *[F.asc(c) for c in KEY])


def opening(chunks: DataFrame, records: DataFrame) -> DataFrame:
    """The first chunk of each of ``records``: the arm over the graph claims a record, not a passage. Records without chunks go."""
    first = chunks.join(records.select("data_id").distinct(), "data_id", "left_semi").groupBy("data_id").agg(F.min("ordinal").alias("ordinal"))
    return records.join(first, "data_id")


def fuse_passages(arms: dict[str, DataFrame], limit: int, rank: str = "rrf") -> DataFrame:
    """arms: data_id, ordinal, score, rank -> data_id, ordinal, score, arms, rank; 2 * limit + 5 rows, so that the cut can be told.

    ``rrf``: reciprocal ranks are added, as scores of arms do not compare. ``none``: the best score of any arm counts. No arms: no rows."""
    parts = [a.select(*KEY, "rank", F.col("score").cast("double").alias("score"), F.lit(n).alias("arm")) for n, a in arms.items()]
    both = reduce(DataFrame.unionByName, parts)
    worth = F.sum(1.0 / (RRF_K + F.col("rank"))) if rank == "rrf" else F.max("score")
    fused = both.groupBy(*KEY).agg(F.round(worth, 6).alias("score"), F.array_join(F.array_sort(F.collect_set("arm")), ",").alias("arms"))
    return ranked(fused, 2 * limit + 5, F.desc("score"), *[F.asc(c) for c in KEY])


def answer(fused: DataFrame, chunks: DataFrame, passages: int, sentences: int = 3, chars: int = 280) -> DataFrame:
    """The passages that an extractive answer quotes: marker, data_id, ordinal, score, quote. The first ``sentences`` of the ``passages`` shown are quoted."""
    top = fused.where(F.col("rank") <= min(passages, sentences)).join(chunks.select(*KEY, "chunk"), list(KEY))
    flat = F.substring(F.trim(F.regexp_replace("chunk", r"[ \t\n\r\f]+", " ")), 1, chars)
    return top.select(F.col("rank").alias("marker"), *KEY, "score", F.concat(flat, F.lit(" ["), F.col("rank").cast("string"), F.lit("]")).alias("quote"))


def resolved(quotes: Column, shown: int) -> Column:
    """The markers [n] of an answer that name one of the passages shown, each once; others point nowhere and are dropped."""
    numbers = F.transform(F.regexp_extract_all(quotes, F.lit(r"\[([0-9]{1,6})\]"), F.lit(1)), lambda x: x.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda x: x.between(1, shown))))


def trace(fused: DataFrame, waiting: DataFrame, limit: int, cited: DataFrame | None = None) -> DataFrame:
    """What a search leaves behind: data_id, rank, score, used, reason, a row for each record.

    Records among the first ``limit`` passages are used, by their best rank; those only beyond it are left out by ``threshold``; the first 25
    of ``waiting`` (data_id, visible and not searchable yet) are ``not_yet_enriched``. Left-out ones are numbered on, each excluded passage
    taking a number. cited (data_id): for an answer, used means cited; what was shown and not cited says so.

    All windows here run over the 2 * limit + 30 rows that the cuts leave."""
    first = lambda rows: rows.groupBy("data_id").agg(F.min_by("score", "rank").alias("score"), F.min("rank").alias("rank"))
    kept = first(fused.where(F.col("rank") <= limit))
    beyond = fused.where(F.col("rank") > limit).join(kept.select("data_id"), "data_id", "left_anti").select("data_id", "score", F.lit("threshold").alias("reason"), F.lit(0).alias("block"), F.col("rank").cast("long").alias("at"))
    late = waiting.select("data_id").distinct().orderBy("data_id").limit(25).select("data_id", F.lit(None).cast("double").alias("score"), F.lit("not_yet_enriched").alias("reason"), F.lit(1).alias("block"), F.col("data_id").alias("at"))
    left_out = beyond.unionByName(late).withColumn("n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("block", "at", "data_id"))).crossJoin(kept.agg(F.count("*").alias("shown")))
    left_out = left_out.groupBy("data_id").agg(F.min_by(F.struct("score", "reason", (F.col("shown") + F.col("n")).alias("rank")), "n").alias("x")).select("data_id", "x.*")
    left_out = left_out.join(kept.select("data_id"), "data_id", "left_anti")
    used = kept.withColumn("used", F.lit(True)) if cited is None else kept.join(cited.select("data_id", F.lit(True).alias("used")).distinct(), "data_id", "left").withColumn("used", F.coalesce("used", F.lit(False)))
    shown = used.select("data_id", F.col("rank").cast("int"), "score", "used", F.when(~F.col("used"), "retrieved_not_cited").alias("reason"))
    return shown.unionByName(left_out.select("data_id", F.col("rank").cast("int"), "score", F.lit(False).alias("used"), "reason"))
