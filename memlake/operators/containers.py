"""Memories and cases: expiry, hierarchy, routing, compaction; lifecycle of records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators.access import strictest
from memlake.operators.running import running

from memlake.operators.written import written


def expiry(added: str = "added_at", ttl: str = "ttl") -> Column:
    """When a membership ends; null if its memory's type has no time to live."""
    return F.col(added) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col(ttl))


def effective_expiry(memberships: DataFrame) -> DataFrame:
    """data_id -> expires_at, binding: an unbounded membership keeps a record for ever, else the latest one binds (the least memory
    id of those that end then)."""
    m = memberships.withColumn("e", expiry())
    g = m.groupBy("data_id").agg(F.count_if(F.col("e").isNull()).alias("unbounded"), F.max("e").alias("latest"), F.max_by("memory_id", F.struct("e", -F.substring("memory_id", 2, 18).cast("long"))).alias("binding"))
    bound = F.col("unbounded") == 0
    return g.select("data_id", F.when(bound, F.col("latest")).alias("expires_at"), F.when(bound, F.col("binding")).alias("binding"))


def closure(links: DataFrame, roots: DataFrame, depth: int = 12) -> DataFrame:
    """links: child, parent; roots: root. (root, id, depth) of everything contained, the root itself included, at its least depth.
    Frontier joins up to ``depth`` levels, ending when a level finds nothing new, so cycles and diamonds end too. Each frontier is
    written before the next is planned."""
    below = written(links.select(F.col("parent").alias("id"), "child").distinct())
    met = roots.select("root", F.col("root").alias("id"), F.lit(0).alias("depth")).distinct()
    frontier = met
    for d in range(1, depth + 1):
        step = frontier.join(below, "id").select("root", F.col("child").alias("id")).distinct().join(met.select("root", "id"), ["root", "id"], "left_anti")
        frontier = written(step.withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        met = met.union(frontier)
    return met


def would_cycle(links: DataFrame, proposed: DataFrame) -> DataFrame:
    """proposed: child, parent -> the same with ``refused``: true if the parent is contained in the child already."""
    below = closure(links, proposed.select(F.col("child").alias("root")), 64).select(F.col("root").alias("child"), F.col("id").alias("parent"), F.lit(True).alias("hit"))
    return proposed.join(below, ["child", "parent"], "left").select("child", "parent", F.coalesce("hit", F.lit(False)).alias("refused"))


def duplicates(records: DataFrame) -> DataFrame:
    """records: data_id, checksum, text -> data_id, kept, bytes_freed. The key is the checksum or, without one, length and first 200
    characters; the newest of a key is kept. The newest id per key is an aggregate joined back, not a window, so that a key with
    many copies is combined before the shuffle and can be split."""
    key = F.coalesce("checksum", F.concat_ws(":", F.length("text").cast("string"), F.substring("text", 1, 200)))
    keyed = records.select("data_id", F.md5(key).alias("key"), F.length("text").alias("chars"))
    newest = keyed.groupBy("key").agg(F.max("data_id").alias("newest"))
    kept = F.col("data_id") == F.col("newest")
    return keyed.join(newest, "key").select("data_id", kept.alias("kept"), F.when(kept, 0).otherwise(F.col("chars")).cast("long").alias("bytes_freed"))


def summary_spans(records: DataFrame, group: str) -> DataFrame:
    """Where each record's text stands in its group's concatenation (two line feeds between texts)."""
    sized = records.select(group, "data_id", F.length("text").alias("size"))
    at = running(sized, [group], ["data_id"], {"span_start": F.col("size") + 2})
    return at.select(group, "data_id", F.col("span_start").cast("long").alias("span_start"), (F.col("span_start") + F.col("size")).cast("long").alias("span_end"))


def summaries(records: DataFrame, group: str, most: int = 200) -> DataFrame:
    """One artifact over the first ``most`` records of each group, by data_id: group, text (trimmed texts with two line feeds between), level
    (the strictest of what it was made of), principals, sources (data_id, span_start, span_end). A group of one record has none: a summary
    of one record is the record. A null text is empty."""
    batch = running(records.select(group, "data_id", F.trim(F.coalesce("text", F.lit(""))).alias("text"), "access_level", "shared_with"), [group], ["data_id"], {"at": F.length(F.trim(F.coalesce("text", F.lit("")))) + 2}).where(F.col("n") <= most)
    level, principals = strictest()
    parts = F.array_sort(F.collect_list(F.struct("data_id", "at", "text")))
    g = batch.groupBy(group).agg(parts.alias("parts"), level.alias("level"), principals.alias("principals")).where(F.size("parts") > 1)
    sources = F.transform("parts", lambda p: F.struct(p["data_id"].alias("data_id"), p["at"].cast("long").alias("span_start"), (p["at"] + F.length(p["text"])).cast("long").alias("span_end")))
    return g.select(group, F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n").alias("text"), "level", "principals", sources.alias("sources"))


def route_cases(records: DataFrame, cases: DataFrame) -> DataFrame:
    """records: data_id, external_id, identifiers; cases: case_id, case_key, identifiers. A case is asserted by its key, else inferred
    (confidence 0.8) by a shared identifier; an asserted basis is never lowered. Arrays are exploded to an equi-join."""
    asserted = records.join(cases.select("case_id", F.col("case_key").alias("external_id")), "external_id").select("data_id", "case_id", F.lit(1.0).alias("confidence"))
    mine = records.select("data_id", F.explode("identifiers").alias("identifier")).distinct()
    theirs = cases.select("case_id", F.explode("identifiers").alias("identifier")).distinct()
    inferred = mine.join(theirs, "identifier").select("data_id", "case_id", F.lit(0.8).alias("confidence"))
    best = asserted.union(inferred).groupBy("data_id", "case_id").agg(F.max("confidence").alias("confidence"))
    return best.withColumn("basis", F.when(F.col("confidence") == 1.0, "asserted").otherwise("inferred"))


def purged(store: DataFrame, gone: DataFrame, reached: Column) -> DataFrame:
    """What a purge leaves of a store: rows of records that are not ``gone``, and those that it did not reach."""
    marked = store.join(gone.select("data_id", F.lit(True).alias("gone")), "data_id", "left")
    return marked.where(F.col("gone").isNull() | ~F.coalesce(reached, F.lit(False))).drop("gone")


def remaining(stores: dict[str, DataFrame], gone: DataFrame) -> DataFrame:
    """tab, remaining, complete: rows of each store that still refer to a record that is ``gone``."""
    counts = [rows.join(gone, "data_id", "left_semi").agg(F.count("*").alias("remaining")).select(F.lit(name).alias("tab"), "remaining") for name, rows in stores.items()]
    return reduce(DataFrame.union, counts).withColumn("complete", F.col("remaining") == 0)
