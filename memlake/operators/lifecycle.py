"""Writes, selections, ownership and audits of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.operators.written import written

#: Relations by name: what kind of subject and object they take, whether they are structural and whether one value holds at a time.
REGISTRY = (
    ("located_in", ("customer", "supplier", "nation"), ("nation", "region"), "structural", True),
    ("produces", ("supplier",), ("part",), "structural", False),
    ("uses", ("customer",), ("part",), "interpretive", False),
)


def registry(spark) -> DataFrame:
    rows = [(n, list(a), list(b), c, s) for n, a, b, c, s in REGISTRY]
    return spark.createDataFrame(rows, "predicate string, domain array<string>, range array<string>, class string, single boolean")


def checked_edges(edges: DataFrame) -> DataFrame:
    """edges: subject_type, predicate, object_type, ... -> the same with class and ``refused``: a type outside the relation's domain or
    range. Unknown relations and types pass."""
    known = edges.join(F.broadcast(registry(edges.sparkSession)), "predicate", "left")
    outside = lambda side, allowed: F.col(side).isNotNull() & ~F.array_contains(allowed, F.col(side))
    refused = F.coalesce(outside("subject_type", "domain") | outside("object_type", "range"), F.lit(False))
    return known.withColumn("refused", refused).withColumn("class", F.coalesce("class", F.lit("interpretive"))).drop("domain", "range", "single")


def merged(entities: DataFrame) -> DataFrame:
    """entities: id, merged_into -> id, survivor: the end of each chain of merges. Every round doubles the reach, until no more chains
    end; what is left then leads into a cycle of merges and stays itself."""
    at = written(entities.select("id", F.coalesce("merged_into", "id").alias("survivor"), F.coalesce(F.col("merged_into") == F.col("id"), F.lit(True)).alias("done")))
    left = at.where("not done").count()
    while left:
        hop = at.select(F.col("id").alias("survivor"), F.col("survivor").alias("next"), F.col("done").alias("ended"))
        at = written(at.join(hop, "survivor", "left").select("id", F.coalesce("next", "survivor").alias("survivor"), (F.col("done") | F.coalesce("ended", F.lit(True))).alias("done")))
        before, left = left, at.where("not done").count()
        if left == before:
            break
    return at.select("id", F.when(F.col("done"), F.col("survivor")).otherwise(F.col("id")).alias("survivor"))


def write_results(rows: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """rows: key, producer_enabled, chars; known: key. Per item what a write did: dropped, refused, updated or created."""
    before = known.select("key", F.lit(True).alias("before")).distinct()
    status = F.when(~F.col("producer_enabled"), "dropped").when(F.coalesce(F.col("chars"), F.lit(0)) > most, "too_large").when(F.col("before"), "updated").otherwise("created")
    return rows.join(before, "key", "left").withColumn("status", status).drop("before")


def deletion_selection(rows: DataFrame, condition: Column | None) -> DataFrame:
    """Records to delete and those on legal hold, which stay. Without a condition it refuses, so that nothing deletes everything."""
    if condition is None:
        raise ValueError("a deletion needs a condition")
    return rows.where(condition).withColumn("held", F.coalesce("legal_hold", F.lit(False)))


def account_plan(rows: DataFrame, user: str) -> DataFrame:
    """What goes with an account and what stays, with the reason."""
    reason = F.when(F.col("owner_id") != user, "not_owner").when(F.col("access_level").isin("org", "public"), "organisation_data").when(F.col("legal_hold"), "legal_hold")
    return rows.withColumn("reason", reason).withColumn("deleted_too", reason.isNull())


def digest(changes: DataFrame, key: str, first: int = 5, chars: int = 200) -> DataFrame:
    """changes: key, seq, kind, significance, statement -> per key: counts by kind, the highest significance, the first statements.
    Only the ``first`` statements of a key are gathered."""
    counts = changes.groupBy(key).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("added", "removed", "altered")], F.max(F.when(F.col("significance") == "high", 3).when(F.col("significance") == "medium", 2).otherwise(1)).alias("rank"), F.min("seq").alias("start"))
    head = changes.join(counts.select(key, "start"), key).where(F.col("seq") < F.col("start") + first)
    said = head.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.substring("statement", 1, chars).alias("s")))), lambda x: x["s"]), " | ").alias("statements"))
    return counts.join(said, key, "left").drop("start")
