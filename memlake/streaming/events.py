"""Operators over the sequenced event log. Each is a function of a DataFrame, so the batch form, the backtest and the body of a
streaming ``foreachBatch`` are one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def gap(events: DataFrame, watermark: int, cap: int) -> DataFrame:
    """The next ``cap`` events after the watermark, by sequence."""
    return events.where(F.col("sequence") > watermark).orderBy("sequence").limit(cap)


def evaluate_gap(events: DataFrame, watermark: int, cap: int, surface: str, condition: Column) -> DataFrame:
    """One row: candidates, matches, the new watermark (the last event scanned, matching or not) and how many events wait beyond."""
    scanned = gap(events, watermark, cap).agg(F.count_if(F.col("surface") == surface).alias("candidates"), F.count_if((F.col("surface") == surface) & condition).alias("matches"), F.coalesce(F.max("sequence"), F.lit(watermark)).alias("watermark"))
    waiting = events.where(F.col("sequence") > watermark).agg(F.greatest(F.count("*") - cap, F.lit(0)).alias("deferred"))
    return scanned.crossJoin(F.broadcast(waiting))


def new_matches(found: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """Matches that the log does not hold, once each."""
    return found.join(log.select(*keys), keys, "left_anti").dropDuplicates(keys)


def timeline(states: DataFrame, key: str, order: str) -> DataFrame:
    """Checkpoints per key: seq, the checksum, and what changed since the one before."""
    w = Window.partitionBy(key).orderBy(order)
    rows = states.withColumn("seq", F.row_number().over(w)).withColumn("checksum", F.sha2(F.coalesce("text", F.lit("")), 256))
    before, maker = F.lag("checksum").over(w), F.lag("generator").over(w)
    outcome = F.when(F.col("seq") == 1, "first").when(before == F.col("checksum"), "unchanged").when(~maker.eqNullSafe(F.col("generator")), "incomparable").otherwise("changed")
    return rows.withColumn("outcome", outcome)


def as_of(rows: DataFrame, probes: DataFrame, key: str, at: str, probe_at: str) -> DataFrame:
    """The last row of each key at or before each probe's time."""
    met = probes.join(rows, key).where(F.col(at) <= F.col(probe_at))
    return met.groupBy(key, probe_at).agg(F.max_by("seq", F.struct(at, "seq")).alias("seq"))


def verify_machine(transitions: DataFrame) -> DataFrame:
    """instance, seq, from_state, to_state -> per instance: transitions, gaps in seq, breaks in the chain, agrees."""
    w = Window.partitionBy("instance").orderBy("seq")
    rows = transitions.withColumn("gap", F.coalesce(F.col("seq") - F.lag("seq").over(w) != 1, F.col("seq") != 1)).withColumn("broken", F.coalesce(F.lag("to_state").over(w) != F.col("from_state"), F.lit(False)))
    g = rows.groupBy("instance").agg(F.count("*").alias("transitions"), F.count_if("gap").alias("gaps"), F.count_if("broken").alias("breaks"))
    return g.withColumn("agrees", (F.col("gaps") == 0) & (F.col("breaks") == 0))


#: Seconds to wait after each failed attempt; the fifth failure is final.
BACKOFF = (10, 60, 300, 1800)


def delivery_state(attempts: DataFrame) -> DataFrame:
    """delivery, attempt, ok, at -> delivery, tries, state, next_attempt."""
    g = attempts.groupBy("delivery").agg(F.count("*").alias("tries"), F.max("ok").alias("ok"), F.max("at").alias("at"))
    state = F.when(F.col("ok"), "delivered").when(F.col("tries") > len(BACKOFF), "dead").otherwise("pending")
    wait = F.get(F.array(*[F.lit(x) for x in BACKOFF]), (F.col("tries") - 1).cast("int"))
    return g.select("delivery", "tries", state.alias("state"), F.when(state == "pending", F.col("at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), wait)).alias("next_attempt"))


def run_standing(spark: SparkSession, source: DataFrame, find: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, keys: list[str]) -> None:
    """Evaluates a streaming source to its end, batch by batch, into an idempotent Parquet log at ``sink``: a repeated batch adds
    nothing, as matches are keyed."""

    def step(batch: DataFrame, _: int) -> None:
        found = find(batch)
        log = spark.read.schema(found.schema).option("ignoreMissingFiles", "true").parquet(sink)
        new_matches(found, log, keys).write.mode("append").parquet(sink)

    spark.createDataFrame([], find(source.sparkSession.createDataFrame([], source.schema)).schema).write.mode("append").parquet(sink)
    source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
