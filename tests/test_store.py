"""The versioned table, the write path, and watches: whole versions, lost races, replays, watermarks that never outrun matches."""

import pytest
from pyspark.sql import functions as F

from memlake.operators.written import new_path
from memlake.store.records import BACKLOG, KEY, Records, admitted
from memlake.store.versions import Taken, Versions
from memlake.streaming.watches import Watch, Watching, World

ITEM = "write_id long, index long, project_id string, producer_id string, external_id string, text string, mime_type string, event_time timestamp_ntz, access_level string, tags array<string>"


def items(spark, *rows):
    return spark.createDataFrame([(w, i, "p", "w", k, t, "text/plain", None, "org", ["a"]) for w, i, k, t in rows], ITEM)


def table(spark, buckets=4):
    return Versions(spark, new_path(spark, "test-versions"), "k long, v string", ("k",), buckets)


def rows(t, version=None):
    return sorted((x.k, x.v) for x in t.read(version).collect())


def test_versions(spark):
    t = table(spark)
    assert t.version() == 0 and rows(t) == []
    frame = lambda *x: spark.createDataFrame(list(x), "k long, v string")
    assert t.upsert(frame((1, "a"), (2, "b"), (3, None))) == 1
    assert t.upsert(frame((2, "B"), (9, "i"))) == 2
    assert t.update_from(frame((1, "!"), (77, "x")), v=F.concat("v", "new.v")) == 3
    assert t.delete_using(frame((3, ""), (3, ""), (50, ""))) == 4
    assert rows(t) == [(1, "a!"), (2, "B"), (9, "i")]
    assert rows(t, 1) == [(1, "a"), (2, "b"), (3, None)] and rows(t, 2) == [(1, "a"), (2, "B"), (3, None), (9, "i")]
    assert t.delete_using(frame()) == 4
    t.delete_using(frame((1, ""), (2, ""), (9, "")))
    assert rows(t) == []


def test_only_touched_buckets_are_rewritten(spark):
    t = table(spark, buckets=8)
    t.upsert(spark.range(200).select(F.col("id").alias("k"), F.lit("x").alias("v")))
    before = t._manifest(t.version())
    t.upsert(spark.createDataFrame([(5, "y")], "k long, v string"))
    after = t._manifest(t.version())
    assert sum(before[b] != after[b] for b in before) == 1 and len(before) == 8


def test_a_lost_race_starts_again_and_an_append_says_so(spark):
    t = table(spark)
    frame = lambda *x: spark.createDataFrame(list(x), "k long, v string")
    t.upsert(frame((1, "a")))
    rival, raced = Versions(spark, t.path, "k long, v string", ("k",), 4), []

    def rewrite(stored):
        if not raced:
            raced.append(rival.upsert(frame((1, "rival"), (2, "rival"))))
        return stored.select("k", F.concat("v", F.lit("+")).alias("v"))

    t.change(frame((1, "")), rewrite)
    assert rows(t) == [(1, "rival+"), (2, "rival")] or rows(t) == [(1, "rival+"), (2, "rival+")]
    base = t.version()
    rival.append(frame((7, "first")), base)
    with pytest.raises(Taken):
        t.append(frame((8, "second")), base)
    assert 8 not in {k for k, _ in rows(t)} and (7, "first") in rows(t)


def test_writes(spark):
    s = Records(spark, new_path(spark, "test-records"), 4)
    told = lambda r: sorted((x.write_id, x["index"], x.status, x.error) for x in r.collect())
    batch = items(spark, (1, 0, "a", "one"), (1, 1, "b", None), (1, 2, "a", "two"), (1, 3, None, "x"))
    first = s.write(batch, "2024-01-01")
    assert told(first) == [(1, 0, "created", None), (1, 1, "created", None), (1, 2, "created", None), (1, 3, "refused", "no_key")]
    ids = {x.external_id: x.data_id for x in s.table.read().collect()}
    state = lambda: {x.external_id: (x.text, x.state, x.deleted_at is not None, x.revision) for x in s.table.read().collect()}
    assert state() == {"a": ("two", "stored", False, 1), "b": (None, "stored", False, 1)}
    s.enriched(s.table.read().select(*KEY, F.lit("enriched").alias("state")), "2024-01-02")
    s.erase(s.table.read().where("external_id = 'b'"), "asked", "2024-01-03")
    assert state() == {"a": ("two", "enriched", False, 1), "b": (None, "erased", True, 1)}
    s.enriched(s.table.read().select(*KEY, F.lit("enriched").alias("state")), "2024-01-04")
    assert state()["b"][1] == "erased"
    again = s.write(batch, "2024-01-05")
    assert told(again) == [(1, 0, "updated", None), (1, 1, "updated", None), (1, 2, "updated", None), (1, 3, "refused", "no_key")]
    assert state() == {"a": ("two", "stored", False, 2), "b": (None, "stored", False, 2)}
    assert {x.external_id: x.data_id for x in s.table.read().collect()} == ids
    kept = sorted((x.data_id, x.revision, x.changed) for x in s.history.read().collect())
    assert kept == sorted([(ids["a"], 1, True), (ids["a"], 2, False), (ids["b"], 1, True), (ids["b"], 2, False)])


def test_admission_limits(spark):
    many = spark.range(501).select(F.lit(1).alias("write_id"), F.col("id").alias("index"), *[F.lit("x").alias(k) for k in KEY], F.lit("t").alias("text"))
    few = many.where("index < 3").withColumn("write_id", F.lit(2))
    large = few.withColumn("write_id", F.lit(3)).withColumn("text", F.repeat(F.lit("é"), 6 << 20))
    got = {(x.write_id, x.refused) for x in admitted(many.union(few).union(large)).select("write_id", "refused").distinct().collect()}
    assert got == {(1, "too_many_items"), (2, None), (3, "too_large")}
    assert admitted(few, spark.range(BACKLOG)).first().refused == "backlog_full"
    assert admitted(few, spark.range(BACKLOG - 1)).first().refused is None


def world(spark, n):
    events = spark.range(n).select(F.col("id").alias("sequence"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("surface"), F.to_json(F.struct((F.col("id") % 10).alias("v"), F.lit("e1").alias("object_id"))).alias("payload"), F.when(F.col("id") % 4 != 2, F.col("id") % 20).alias("data_id"), F.when(F.col("id") % 4 == 2, F.col("id") % 6).alias("fact_id"))
    records = spark.range(20).select(F.col("id").alias("data_id"), F.lit("note").alias("data_type"), F.array(F.lit("t")).alias("tags"), F.when(F.col("id") % 3 == 0, "a running dog").alias("text"), (F.col("id") % 2 == 0).alias("visible"))
    evidence = spark.createDataFrame([(0, 5), (0, 7), (2, 1), (4, None)], "fact_id long, data_id long")
    members = spark.createDataFrame([("memory", "inner", 5), ("memory", "outer", 12), ("case", "c", 5), ("case", "c", 12)], "kind string, container string, data_id long")
    contained = spark.createDataFrame([("outer", "outer"), ("outer", "inner"), ("inner", "inner")], "memory string, part string")
    return World(events, records, evidence, members, contained)


WATCHES = [
    Watch("v", "a", 7, {"v": {"op": "gt", "value": 5}}),
    Watch("dogs", "b", 5, question='"run dogs" -cat', data_type="note", tags=("t", "u")),
    Watch("outer", "a", 6, memory="outer"),
    Watch("inner_case", "a", 50, memory="inner", case="c"),
    Watch("nobody", "a", 50, entity="e2"),
    Watch("quiet", "none", 5),
]


def test_many_runs_equal_one_and_a_cap_loses_nothing(spark):
    whole = Watching(spark, new_path(spark, "test-watch"))
    one = {x.watch: x for x in whole.run([Watch(**{**w.__dict__, "cap": 10_000}) for w in WATCHES], world(spark, 60)).collect()}
    assert all(x.deferred == 0 for x in one.values()) and one["nobody"].matches == one["quiet"].candidates == 0 and one["quiet"].window_to == -1
    # The facts 0 and 2 stand on the records 5, 7 and 1; only 5 is in a container, so facts of events 18, 42 (and 6, 30, 54: fact 0) count.
    parts = Watching(spark, new_path(spark, "test-watch"))
    seen = 0
    for n in (20, 20, 40, 60, 60, 60, 60):
        report = {x.watch: x for x in parts.run(WATCHES, world(spark, n)).collect()}
        assert all(x.candidates <= w.cap for w in WATCHES for x in [report[w.name]])
        seen += report["v"].candidates
    key = lambda w: sorted((x.watch, x.sequence, x.data_id, x.visible) for x in w.matches().collect())
    assert key(parts) == key(whole) and len(key(whole)) == len(set(key(whole)))
    assert seen == 30 and {x.watch for x in whole.matches().collect()} == {"v", "dogs", "outer", "inner_case"}
    expect = {i for i in range(0, 60, 2) if (i % 4 != 2 and i % 20 in (5, 12)) or (i % 4 == 2 and i % 6 == 0)}
    assert {x.sequence for x in whole.matches().where("watch = 'outer'").collect()} == expect
    assert {x.sequence for x in whole.matches().where("watch = 'inner_case'").collect()} == {i for i in expect if i % 4 == 2}


def test_a_backtest_writes_nothing_and_a_race_records_once(spark):
    w = Watching(spark, new_path(spark, "test-watch"))
    report = w.run(WATCHES[:1], world(spark, 60), record=False, since=9).first()
    assert report.window_from == 9 and report.candidates == 7 and list(report.samples) == [16, 18] and w.log.version() == 0
    rival = Watching(spark, w.path)
    plain, raced = w.log.append, []

    def append(found, base):
        if not raced:
            raced.append(rival.run(WATCHES[:1], world(spark, 60)).first().window_to)
        return plain(found, base)

    w.log.append = append
    after = w.run(WATCHES[:1], world(spark, 60)).first()
    assert raced == [12] and after.window_from == 12
    held = [x.sequence for x in w.matches().collect()]
    assert len(held) == len(set(held))


def test_a_load_is_taken_whole_whatever_waits(spark):
    s = Records(spark, new_path(spark, "test-records"), 4)
    item = lambda frm, to: spark.range(frm, to).select((F.col("id") / 400).cast("long").alias("write_id"), F.col("id").alias("index"), F.lit("p").alias("project_id"), F.lit("w").alias("producer_id"), F.concat(F.lit("x"), "id").alias("external_id"), F.lit("t").alias("text"), F.lit("text/plain").alias("mime_type"), F.lit(None).cast("timestamp_ntz").alias("event_time"), F.lit("org").alias("access_level"), F.array(F.lit("a")).alias("tags"))
    assert s.write(item(0, BACKLOG), "2024-01-01", live=False).where("error is null").count() == BACKLOG
    late = item(BACKLOG - 1, BACKLOG + 2)
    assert {x.error for x in s.write(late, "2024-01-02").collect()} == {"backlog_full"}
    assert sorted(x.status for x in s.write(late, "2024-01-03", live=False).collect()) == ["created", "created", "updated"]
