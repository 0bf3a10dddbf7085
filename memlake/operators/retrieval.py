"""Arms of hybrid retrieval, their fusion, and what was left out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def over_fetch(limit: int) -> int:
    return max(4 * limit, 40)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def ranked(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The k first rows with their rank. The cut comes first, so that the single-partition window sees k rows only."""
    return rows.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def vector_arm(vectors: DataFrame, probe: list[float], k: int) -> DataFrame:
    """vectors: data_id, vector (one model, access already applied) -> data_id, score, rank."""
    scored = vectors.select("data_id", F.round(cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in probe])), 6).alias("score"))
    return ranked(scored, k, F.desc("score"), F.asc("data_id"))


def terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def lexical_arm(texts: DataFrame, words: list[str], k: int) -> DataFrame:
    """Token-overlap form: the number of distinct query words in a text. texts: data_id, text."""
    scored = texts.select("data_id", F.size(F.array_intersect(terms(F.col("text")), F.array(*[F.lit(w) for w in words]))).cast("double").alias("score"))
    return ranked(scored.where("score > 0"), k, F.desc("score"), F.asc("data_id"))


def fuse(arms: dict[str, DataFrame], limit: int) -> DataFrame:
    """Reciprocal rank fusion: data_id, score, arms, rank; 2 * limit + 5 rows, so that the caller can tell what was left out."""
    parts = [a.select("data_id", "rank", F.lit(n).alias("arm")) for n, a in arms.items()]
    both = reduce(DataFrame.unionByName, parts)
    fused = both.groupBy("data_id").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 6).alias("score"), F.array_join(F.array_sort(F.collect_set("arm")), ",").alias("arms"))
    return ranked(fused, 2 * limit + 5, F.desc("score"), F.asc("data_id"))


def exclusions(fused: DataFrame, stored: DataFrame, limit: int) -> DataFrame:
    """data_id, reason: ranked beyond the limit, or visible but not searchable yet (the first 25)."""
    beyond = fused.where(F.col("rank") > limit).select("data_id", F.lit("threshold").alias("reason"))
    waiting = stored.orderBy("data_id").limit(25).select("data_id", F.lit("not_yet_enriched").alias("reason"))
    return beyond.unionByName(waiting)


def passages(cited: DataFrame, texts: DataFrame, n: int = 3, chars: int = 280) -> DataFrame:
    """The extractive answer's sentences: the first n cited texts, white space collapsed and cut, with their marker."""
    top = cited.where(F.col("rank") <= n).join(texts.select("data_id", "text"), "data_id")
    flat = F.substring(F.trim(F.regexp_replace("text", r"[ \t\n\r\f]+", " ")), 1, chars)
    return top.select("rank", "data_id", F.concat(flat, F.lit(" ["), F.col("rank").cast("string"), F.lit("]")).alias("passage"))


@dataclass(frozen=True)
class Filter:
    """What a search is narrowed to. Empty tuples and None filter nothing; both ends of the time range are included."""

    project: str | None = None
    tags: tuple[str, ...] = ()
    memories: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    template: str | None = None
    entities: tuple[str, ...] = ()
    since: str | None = None
    until: str | None = None


def narrowed(records: DataFrame, f: Filter, members: DataFrame, artifacts: DataFrame, mentions: DataFrame) -> DataFrame:
    """records: data_id, project_id, tags, template, event_time; members: memory_id, data_id; artifacts: data_id, keywords; mentions:
    entity, data_id. Semi-joins, so that a record in several memories stays one row."""
    listed = lambda xs: F.array(*[F.lit(x) for x in xs])
    if f.project is not None:
        records = records.where(F.col("project_id") == f.project)
    if f.tags:
        records = records.where(F.arrays_overlap("tags", listed(f.tags)))
    if f.template is not None:
        records = records.where(F.col("template") == f.template)
    if f.since is not None:
        records = records.where(F.col("event_time") >= F.lit(f.since).cast("timestamp_ntz"))
    if f.until is not None:
        records = records.where(F.col("event_time") <= F.lit(f.until).cast("timestamp_ntz"))
    if f.memories:
        records = records.join(members.where(F.col("memory_id").isin(*f.memories)).select("data_id"), "data_id", "left_semi")
    if f.keywords:
        records = records.join(artifacts.where(F.arrays_overlap("keywords", listed(f.keywords))).select("data_id"), "data_id", "left_semi")
    if f.entities:
        records = records.join(mentions.where(F.col("entity").isin(*f.entities)).select("data_id"), "data_id", "left_semi")
    return records


def graph_arm(reached: DataFrame, mentions: DataFrame, records: DataFrame, k: int) -> DataFrame:
    """reached: id, hops; mentions: id, data_id; records: data_id, visible and narrowed. Records by their nearest entity, then by the
    number of mentions -> data_id, hops, mentions, score, rank."""
    touched = mentions.join(reached, "id").groupBy("data_id").agg(F.min("hops").alias("hops"), F.count("*").alias("mentions"))
    seen = touched.join(records.select("data_id"), "data_id", "left_semi").withColumn("score", F.when(F.col("hops") == 0, 1.0).otherwise(0.5))
    return ranked(seen, k, F.asc("hops"), F.desc("mentions"), F.asc("data_id"))
