"""Reads of single records and what is derived from them, the trail that reads and writes leave, and sweeps by policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.operators.access import Principal, rank, visible
from memlake.operators.containers import closure

#: What becomes of a record whose time is up, by the policy of the memory that binds it.
POLICIES = {"orphan_delete": "deleted", "archive": "archived", "keep_members": "refiled"}


def readable_artifacts(artifacts: DataFrame, sources: DataFrame, who: Principal) -> DataFrame:
    """artifacts with levels of their own; sources: artifact_id, data_id, ... -> the artifacts of each record that ``who`` may read. A shared record does
    not publish what was derived from it, and an artifact may be seen where its record is not."""
    return artifacts.where(visible(who)).join(sources, "artifact_id")


def looked_up(records: DataFrame, asked: DataFrame, artifacts: DataFrame, sources: DataFrame, members: DataFrame, who: Principal) -> DataFrame:
    """asked: data_id. The records asked for that ``who`` may see, with the artifacts that they may read and the memories that hold them. Others have no
    row, whether they exist or not."""
    own = records.where(visible(who)).join(asked.select("data_id").distinct(), "data_id", "left_semi")
    of = sources.join(own.select("data_id"), "data_id", "left_semi")
    made = readable_artifacts(artifacts, of, who).groupBy("data_id").agg(F.countDistinct("artifact_id").alias("artifacts"))
    held = members.join(own.select("data_id"), "data_id", "left_semi").groupBy("data_id").agg(F.countDistinct("memory_id").alias("memories"))
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return own.join(made, "data_id", "left").join(held, "data_id", "left").select("data_id", "project_id", "access_level", "event_time", count("artifacts"), count("memories"))


def audit_trail(writes: DataFrame, reads: DataFrame, org: str, project: str | None, limit: int = 100) -> DataFrame:
    """writes and reads: id, org_id, project_id, action, subject, actor, at -> store, id, action, subject, actor, at: the last ``limit`` of each store, shown
    together and kept apart."""
    parts = []
    for name, store in (("writes", writes), ("reads", reads)):
        own = store.where(F.col("org_id") == org)
        own = own if project is None else own.where(F.col("project_id") == project)
        parts.append(own.orderBy(F.desc("at"), "id").limit(limit).select(F.lit(name).alias("store"), "id", "action", "subject", "actor", "at"))
    return parts[0].unionByName(parts[1])


def sweep(due: DataFrame, memories: DataFrame, holds: DataFrame) -> DataFrame:
    """due: data_id, binding, expires_at; memories: memory_id, on_expiry; holds: data_id under a legal hold -> data_id, binding, outcome.

    Deletion spares what is held, archiving and refiling do not erase and go on. A memory without a policy, or one that is not known, keeps its records."""
    met = due.join(memories.select(F.col("memory_id").alias("binding"), "on_expiry"), "binding", "left").join(holds.select("data_id", F.lit(True).alias("held")).distinct(), "data_id", "left")
    act = F.coalesce(*[F.when(F.col("on_expiry") == k, v) for k, v in POLICIES.items()], F.lit("kept"))
    return met.select("data_id", "binding", F.when((act == "deleted") & F.col("held"), "held").otherwise(act).alias("outcome"))


def in_scope_of(links: DataFrame, members: DataFrame, records: DataFrame, root: str, who: Principal, archived: Column) -> DataFrame:
    """The distinct records of a memory and of all that it contains that ``who`` may see and that are not archived, with the least depth at which each is held."""
    inside = closure(links, members.sparkSession.createDataFrame([(root,)], "root string")).select(F.col("id").alias("memory_id"), "depth")
    held = members.join(inside, "memory_id").groupBy("data_id").agg(F.min("depth").alias("depth"))
    return records.where(visible(who) & ~archived).join(held, "data_id").select("data_id", "depth")


def strictest_owner(scope: DataFrame, records: DataFrame) -> DataFrame:
    """One row: level and owner of the strictest record of a scope, the least record of equals; what is made of the scope belongs to them."""
    own = records.join(scope.select("data_id"), "data_id", "left_semi")
    return own.agg(F.min_by(F.struct("access_level", "owner_id"), F.struct(rank(F.col("access_level")), "data_id")).alias("x")).select("x.*").where("owner_id is not null")


def stale_ancestors(derived: DataFrame, changed: DataFrame, depth: int = 64) -> DataFrame:
    """derived: child, parent (a memory and one that it was derived from); changed: root. Everything derived from what changed, at any depth, with the least
    number of steps: each is stale and none of them changed itself."""
    return closure(derived, changed, depth).where("depth > 0").groupBy("id").agg(F.min("depth").alias("steps"))
