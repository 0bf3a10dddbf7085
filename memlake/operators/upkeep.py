"""Links between memories by who says so, what is to be processed again, and overviews of a platform and its watches."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.operators.access import Principal, visible
from memlake.operators.components import on_circles

#: Relations of memories, and who may say that one holds; the first is a statement, the others are guesses.
RELATIONS = ("part_of", "derived_from", "about", "continues", "supersedes")
ORIGINS = ("explicit", "routed", "agent")
LINK = ["source", "relation", "target"]


def linked(standing: DataFrame, asked: DataFrame, memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """standing: source, relation, target, created_by, confidence; asked: the same with seq, the order of asking; memories: memory_id. Returns the links
    after it, and what was refused: seq, error.

    A statement is never overwritten by a guess and makes one of it, without a confidence; of guesses the last stands. Refused are unknown
    relations and origins, a memory linked to itself, a statement with a confidence, memories that are not there, and links that lead back:
    per relation, an asked link is refused if its target leads to its source by standing and asked links together, so that of links that
    close a circle between them none is taken and the order of asking decides nothing. An asked link is among those, so it lies on a circle."""
    known = memories.select("memory_id").distinct()
    met = asked.join(known.select(F.col("memory_id").alias("source"), F.lit(True).alias("_s")), "source", "left").join(known.select(F.col("memory_id").alias("target"), F.lit(True).alias("_t")), "target", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    error = (
        F.when(~yes(F.col("relation").isin(*RELATIONS)), "unknown_relation").when(~yes(F.col("created_by").isin(*ORIGINS)), "unknown_origin")
        .when(F.col("source") == F.col("target"), "linked_to_itself").when((F.col("created_by") == "explicit") & F.col("confidence").isNotNull(), "statement_with_confidence")
        .when(F.col("_s").isNull() | F.col("_t").isNull(), "no_such_memory")
    )
    judged = met.withColumn("error", error)
    good = judged.where("error is null")
    place = lambda c: F.concat("relation", F.lit(":"), c)
    ways = standing.select(place("source").alias("a"), place("target").alias("b")).union(good.select(place("source"), place("target")))
    back = on_circles(ways).select(F.col("a").alias("_from"), F.col("b").alias("_to"), F.lit(True).alias("_closes"))
    good = good.withColumn("_to", place("target")).withColumn("_from", place("source")).join(back, ["_to", "_from"], "left")
    taken = good.where("_closes is null").select(*LINK, "created_by", "confidence", "seq")
    every = standing.select(*LINK, "created_by", "confidence", F.lit(-1).cast("long").alias("seq")).unionByName(taken)
    stated = F.max(F.col("created_by") == "explicit")
    after = every.groupBy(*LINK).agg(F.when(stated, "explicit").otherwise(F.max_by("created_by", "seq")).alias("created_by"), F.when(~stated, F.max_by("confidence", "seq")).alias("confidence"))
    refused = judged.where("error is not null").select("seq", "error").unionByName(good.where("_closes").select("seq", F.lit("closes_a_circle").alias("error")))
    return after, refused


@dataclass(frozen=True)
class Again:
    """What is to be processed again; every condition narrows, none at all is refused. ``stale_generator`` names the current one: records with an artifact of another are meant."""

    data_ids: tuple[int, ...] = ()
    data_type: str | None = None
    run_id: str | None = None
    tags: tuple[str, ...] = ()
    stale_generator: str | None = None
    stale_only: bool = False


def to_reprocess(records: DataFrame, artifacts: DataFrame, sources: DataFrame, again: Again, who: Principal) -> DataFrame:
    """records with data_type, run_id, tags and text; artifacts: artifact_id, generator_version, stale_reason; sources: artifact_id, data_id -> the
    records that ``who`` sees, that have a text and that meet every condition. A record without artifacts meets neither condition on them."""
    tests: list[Column] = []
    if again.data_ids:
        tests.append(F.col("data_id").isin(*again.data_ids))
    if again.data_type is not None:
        tests.append(F.col("data_type") == again.data_type)
    if again.run_id is not None:
        tests.append(F.col("run_id") == again.run_id)
    if again.tags:
        tests.append(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in again.tags])))
    found = records.where(visible(who) & F.col("text").isNotNull() & reduce(lambda a, b: a & b, tests, F.lit(True)))
    made = []
    if again.stale_generator is not None:
        made.append(F.col("generator_version") != again.stale_generator)
    if again.stale_only:
        made.append(F.col("stale_reason").isNotNull())
    if not tests and not made:
        raise ValueError("a selection must narrow something")
    for test in made:
        found = found.join(artifacts.where(test).join(sources, "artifact_id").select("data_id"), "data_id", "left_semi")
    return found


def platform_health(records: DataFrame, shares: DataFrame, now: Column) -> DataFrame:
    """records: org_id, project_id, state, parse_status, deleted_at, purged_at; shares: expires_at, revoked_at -> measure, key, n: counts and never content. Tombstones
    count as unpurged after an hour."""
    live = records.where("deleted_at is null")
    count = lambda rows, name, key: rows.groupBy(key.cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit(name).alias("measure"), "key", "n")
    all_ = F.lit(None)
    late = (F.col("deleted_at") < now - F.expr("interval 1 hour")) & F.col("purged_at").isNull()
    parts = [
        count(live, "items_by_state", F.col("state")), count(live.where("parse_status <> 'parsed'"), "parse_problems", F.col("parse_status")), count(live, "items", all_), count(records.where(late), "unpurged_tombstones", all_),
        count(shares.where(F.col("revoked_at").isNull() & (F.col("expires_at") > now)), "live_shares", all_), count(records.select("org_id").distinct(), "orgs", all_), count(records.select("org_id", "project_id").distinct(), "projects", all_),
    ]
    return reduce(DataFrame.union, parts)


def watch_list(watches: DataFrame, matches: DataFrame, runs: DataFrame) -> DataFrame:
    """watches: watch; matches: watch, at; runs: watch, at -> watch, matches, last_match, last_run; a watch that never matched or ran is there too."""
    met = matches.groupBy("watch").agg(F.count("*").alias("matches"), F.max("at").alias("last_match"))
    ran = runs.groupBy("watch").agg(F.max("at").alias("last_run"))
    return watches.join(met, "watch", "left").join(ran, "watch", "left").select("watch", F.coalesce("matches", F.lit(0)).alias("matches"), "last_match", "last_run")
