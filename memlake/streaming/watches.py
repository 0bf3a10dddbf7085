"""Alerts and standing queries over the sequenced log, evaluated as far as the log goes and remembered.

A run looks at the events beyond each watch's watermark, at most ``cap`` of its surface, and appends its matches and the new watermark to
one log in one version (``store.versions``). So a watermark never stands for matches that were not written, a run that fails leaves
nothing, and of two runs at once the second finds its version taken and looks again. What a cap leaves is counted and comes in the next run.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.functions.selectors import compile_selector
from memlake.operators.written import written
from memlake.search.analysis import positions
from memlake.search.question import parse, score
from memlake.store.versions import TRIES, Taken, Versions

#: Fixed value: matches that a report shows.
SAMPLES = 25
LOG = "watch string, kind string, sequence long, data_id long, visible boolean"


@dataclass(frozen=True)
class Watch:
    """``selector``: conditions on the event's payload. ``question``, ``data_type``, ``tags``: conditions on the record that it names.
    ``memory``, ``case``, ``producer``: containers that hold a record behind the event. ``entity``: an end of the event's fact. All that
    are given must hold."""

    name: str
    surface: str
    cap: int = 500
    selector: dict = field(default_factory=dict)
    question: str | None = None
    data_type: str | None = None
    tags: tuple[str, ...] = ()
    memory: str | None = None
    case: str | None = None
    producer: str | None = None
    entity: str | None = None


@dataclass(frozen=True)
class World:
    """events: sequence, surface, payload (JSON), data_id, fact_id; records: data_id, data_type, tags, text, visible (to the watch's owner);
    evidence: fact_id, data_id; members: kind (memory, case, producer), container, data_id; contained: memory, part, every part
    of a memory at any depth, itself included."""

    events: DataFrame
    records: DataFrame
    evidence: DataFrame
    members: DataFrame
    contained: DataFrame


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _answers(watches: list[Watch]):
    asked = {w.name: (parse(w.question), w.question) for w in watches if w.question}

    @F.pandas_udf("boolean")
    def run(names: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([score(asked[n][0], positions(t, "english")) is not None if n in asked else True for n, t in zip(names, texts, strict=True)], dtype=bool)

    return run


def in_scope(found: DataFrame, watches: list[Watch], world: World) -> DataFrame:
    """found: watch, sequence, data_id, fact_id. Rows that stand on a record in every container of their watch: the event's own record, or
    any piece of evidence of its fact where it has none. A watch without containers keeps all; an asserted fact has no evidence and is in none."""
    for kind in ("memory", "case", "producer"):
        wanted = [(w.name, getattr(w, kind)) for w in watches if getattr(w, kind)]
        if not wanted:
            continue
        scope = found.sparkSession.createDataFrame(wanted, "watch string, container string")
        if kind == "memory":
            scope = scope.join(world.contained.withColumnRenamed("memory", "container"), "container").select("watch", F.col("part").alias("container")).distinct()
        allowed = world.members.where(F.col("kind") == kind).join(scope, "container").select("watch", "data_id").distinct()
        scoped = found.where(F.col("watch").isin([n for n, _ in wanted]))
        own = scoped.where("data_id is not null").select("watch", "sequence", "data_id")
        through = scoped.where("data_id is null").join(world.evidence.select("fact_id", F.col("data_id").alias("behind")), "fact_id").select("watch", "sequence", "behind")
        backed = own.union(through).join(allowed, ["watch", "data_id"], "left_semi").select("watch", "sequence").distinct()
        found = found.where(~F.col("watch").isin([n for n, _ in wanted])).unionByName(scoped.join(backed, ["watch", "sequence"], "left_semi"))
    return found


def look(watches: list[Watch], marks: dict[str, int], world: World) -> tuple[DataFrame, DataFrame]:
    """The matches (watch, sequence, data_id, visible) beyond the watermarks, and a row for each watch: window_from, window_to, candidates, deferred.

    The window goes by events of the surface, matching or not, so that a selective watch moves on. Events are read from the least watermark on."""
    spark = world.events.sparkSession
    state = spark.createDataFrame([(w.name, w.surface, marks.get(w.name, -1), w.cap) for w in watches], "watch string, surface string, mark long, cap int")
    fresh = world.events.where(F.col("sequence") > min(marks.get(w.name, -1) for w in watches)).join(F.broadcast(state), "surface").where("sequence > mark")
    window = fresh.withColumn("place", F.row_number().over(Window.partitionBy("watch").orderBy("sequence"))).where(F.col("place") <= max(w.cap for w in watches)).where("place <= cap")
    window = written(window.select("watch", "sequence", "payload", "data_id", "fact_id"))
    seen = window.groupBy("watch").agg(F.max("sequence").alias("window_to"), F.count("*").alias("candidates"))
    ahead = fresh.groupBy("watch").agg(F.count("*").alias("ahead"))
    runs = state.select("watch", F.col("mark").alias("window_from")).join(seen, "watch", "left").join(ahead, "watch", "left")
    runs = runs.select("watch", "window_from", F.coalesce("window_to", "window_from").alias("window_to"), F.coalesce("candidates", F.lit(0)).alias("candidates"), (F.coalesce("ahead", F.lit(0)) - F.coalesce("candidates", F.lit(0))).alias("deferred"))
    ends = lambda w: _any([F.get_json_object("payload", f"$.{end}") == w.entity for end in ("subject_id", "object_id")])
    chosen = window.where(_any([(F.col("watch") == w.name) & compile_selector(w.selector, F.col("payload")) & (ends(w) if w.entity else F.lit(True)) for w in watches]))
    chosen = in_scope(chosen, watches, world)
    about = world.records.select("data_id", "data_type", "tags", "text", "visible")
    met = chosen.join(about, "data_id", "left")
    tests = []
    for w in watches:
        test = F.col("watch") == w.name
        if w.question or w.data_type or w.tags:
            test &= F.col("visible").isNotNull()
        if w.data_type:
            test &= F.col("data_type") == w.data_type
        if w.tags:
            test &= F.arrays_overlap("tags", F.array(*[F.lit(t) for t in w.tags]))
        tests.append(test)
    met = met.where(_any(tests))
    if any(w.question for w in watches):
        met = met.where(_answers(watches)("watch", "text"))
    return met.select("watch", "sequence", "data_id", F.coalesce("visible", F.lit(False)).alias("visible")), runs


@dataclass
class Watching:
    """The log of matches and watermarks under one folder."""

    spark: SparkSession
    path: str
    buckets: int = 8

    def __post_init__(self) -> None:
        self.log = Versions(self.spark, self.path, LOG, ("watch",), self.buckets)

    def marks(self, version: int | None = None) -> dict[str, int]:
        """The watermark of each watch, one number for each."""
        return {r.watch: r.mark for r in self.log.read(version).where("kind = 'mark'").groupBy("watch").agg(F.max("sequence").alias("mark")).collect()}

    def matches(self) -> DataFrame:
        return self.log.read().where("kind = 'match'").drop("kind")

    def run(self, watches: list[Watch], world: World, record: bool = True, since: int | None = None) -> DataFrame:
        """One pass of all watches: watch, window_from, window_to, candidates, matches, withheld, deferred, samples. ``record=False`` is the
        backtest, the same pass from ``since`` that writes nothing."""
        for attempt in range(TRIES):
            base = self.log.version()
            marks = self.marks(base) if since is None else {w.name: since for w in watches}
            found, runs = (written(x) for x in look(watches, marks, world))
            if record:
                moved = runs.select("watch", F.lit("mark").alias("kind"), F.col("window_to").alias("sequence"), F.lit(None).cast("long").alias("data_id"), F.lit(None).cast("boolean").alias("visible"))
                try:
                    self.log.append(found.select("watch", F.lit("match").alias("kind"), "sequence", "data_id", "visible").unionByName(moved), base)
                except Taken:
                    if attempt == TRIES - 1:
                        raise
                    continue
            place = F.row_number().over(Window.partitionBy("watch").orderBy("sequence"))
            first = found.withColumn("place", place).where(F.col("place") <= SAMPLES).groupBy("watch").agg(F.array_sort(F.collect_list("sequence")).alias("samples"))
            counts = found.groupBy("watch").agg(F.count("*").alias("matches"), F.count_if(~F.col("visible")).alias("withheld"))
            out = runs.join(counts, "watch", "left").join(first, "watch", "left")
            return out.select("watch", "window_from", "window_to", "candidates", F.coalesce("matches", F.lit(0)).alias("matches"), F.coalesce("withheld", F.lit(0)).alias("withheld"), "deferred", F.coalesce("samples", F.array().cast("array<long>")).alias("samples"))
        raise AssertionError
