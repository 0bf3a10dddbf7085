"""Where a write, a match and a delivery go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def route(writes: DataFrame, members: DataFrame) -> DataFrame:
    """The memory of each write: data_id, type, memory_key, owner_id, provenance.

    writes: data_id, project_id, owner_id, scope, asked_type, asked_key. An explicit request wins; a record that is in a memory
    already stays where it is (all null); any other goes to the default memory, the project's for a shared connection, else the owner's."""
    held = members.select("data_id").distinct().withColumn("held", F.lit(True))
    asked = F.coalesce(F.nullif("asked_type", F.lit("")), F.nullif("asked_key", F.lit(""))).isNotNull()
    stays, shared = ~asked & F.col("held").isNotNull(), F.col("scope").eqNullSafe("shared")
    kind = F.when(asked, F.coalesce(F.nullif("asked_type", F.lit("")), F.lit("default"))).otherwise("default")
    key = F.when(asked, F.nullif("asked_key", F.lit(""))).when(shared, F.col("project_id")).otherwise(F.col("owner_id"))
    owner = F.when(asked | ~shared, F.col("owner_id"))
    given = {"type": kind, "memory_key": key, "owner_id": owner, "provenance": F.when(asked, "explicit").otherwise("routed")}
    return writes.join(held, "data_id", "left").select("data_id", *[F.when(~stays, v).alias(k) for k, v in given.items()])


def poll(observed: DataFrame, facts: DataFrame, records: DataFrame, memories: DataFrame, since: int, limit: int) -> DataFrame:
    """The next observed events after a cursor that a reader may see: those about a fact, a record or a memory that they may see.

    observed: sequence, fact_id, data_id, memory_id; the others hold the visible keys. A fact decides where there is one, a
    record only where there is none; a visible memory always suffices."""
    after = observed.where(F.col("sequence") > since)
    mark = lambda df, key: df.select(key).distinct().withColumn(f"sees_{key}", F.lit(True))
    for df, key in ((facts, "fact_id"), (records, "data_id"), (memories, "memory_id")):
        after = after.join(mark(df, key), key, "left")
    sees = (
        F.col("sees_fact_id").isNotNull()
        | (F.col("fact_id").isNull() & F.col("sees_data_id").isNotNull())
        | F.col("sees_memory_id").isNotNull()
    )
    return after.where(sees).select("sequence", "fact_id", "data_id", "memory_id").orderBy("sequence").limit(limit)


def fan_out(matches: DataFrame, subscriptions: DataFrame, delivered: DataFrame) -> DataFrame:
    """Deliveries not made yet: matches (event_id, project_id, alert_id) to enabled subscriptions of the project, those of that alert
    and those of every alert. Two equi-joins in place of one with a disjunction."""
    live = subscriptions.where("enabled and kind = 'alert'").select("subscription_id", "project_id", "alert_id")
    specific = matches.join(live.where("alert_id is not null"), ["project_id", "alert_id"]).select("subscription_id", "event_id")
    every = matches.join(live.where("alert_id is null").drop("alert_id"), "project_id").select("subscription_id", "event_id")
    return specific.union(every).distinct().join(delivered, ["subscription_id", "event_id"], "left_anti")
