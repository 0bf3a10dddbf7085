"""The streaming forms give the rows of the batch forms."""

import pytest
from pyspark.sql import functions as F

from memlake.operators.folds import folded
from memlake.plans.state_queries import DELIVERY_KINDS, FLOW, LEASE_KINDS, group_of, inputs, signals
from memlake.streaming.events import run_standing
from memlake.streaming.leases import ROCKSDB, Delivery, Lease, Workflow, kept
from memlake.streaming.machine import ORDER_LIFE, breaker, reachable, replay, replay_stream

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture()
def halves(spark, tmp_path):
    """The log as a stream of two files, in order."""
    e = spark.read.parquet(EVENTS)
    for n, part in enumerate((e.where("event_id < 500"), e.where("event_id >= 500"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))


def test_replay_stream_equals_batch(spark, halves, tmp_path):
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    replay_stream(inputs(halves), ORDER_LIFE, budget=5).writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out).awaitTermination()
    want = replay(inputs(spark.read.parquet(EVENTS)), ORDER_LIFE, budget=5)
    got = spark.read.parquet(out)
    assert want.count() == got.count() > 0 and want.exceptAll(got).isEmpty()
    assert {r.outcome for r in want.select("outcome").distinct().collect()} >= {"applied", "no_transition"}


def test_standing_stream_equals_batch_and_repeats_add_nothing(spark, halves, tmp_path):
    find = lambda e: e.where("event_type = 'error'").select(F.col("user_id").alias("query_id"), (F.col("event_id") % 97).alias("data_id"))
    sink = str(tmp_path / "matches")
    for again in ("a", "b"):
        run_standing(spark, halves, find, sink, str(tmp_path / f"mark-{again}"), ["query_id", "data_id"])
        want = find(spark.read.parquet(EVENTS)).distinct()
        got = spark.read.parquet(sink)
        assert got.count() == want.count() and want.exceptAll(got).isEmpty()


def test_machine_rules(spark):
    rows = [(1, 1, "signup", "x"), (1, 2, "click", "x"), (1, 3, "purchase", "guest"), (1, 3, "purchase", "buyer"), (1, 4, "purchase", "buyer"), (1, 5, "view", "x")]
    got = replay(spark.createDataFrame(rows, "instance long, seq long, input string, actor string"), ORDER_LIFE).orderBy("seq").collect()
    assert [(x.seq, x.to_state, x.outcome) for x in got] == [(1, "open", "applied"), (2, "active", "applied"), (3, "active", "actor_refused"), (4, "done", "applied"), (5, "done", "no_transition")]
    assert reachable(ORDER_LIFE) == {"new", "open", "active", "done", "failed"}


def test_breaker(spark):
    rows = [(1, n, n * 10, ok) for n, ok in enumerate([True, False, False, True, True, False, True])]
    calls = spark.createDataFrame(rows, "engine long, seq long, t int, ok boolean").selectExpr("engine", "seq", "timestamp_seconds(t)::timestamp_ntz AS ts", "ok")
    assert [x.state for x in breaker(calls, 2, 15).orderBy("seq").collect()] == ["closed", "closed", "closed", "open", "trial", "closed", "closed"]


@pytest.fixture()
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


@pytest.mark.parametrize("name", ["lease", "delivery", "workflow"])
def test_timers_on_a_stream_equal_the_table_over_a_restart(spark, rocks, tmp_path, name):
    """Three batches, the last of them after the query was stopped and started from its checkpoint."""
    policy, lens = {
        "lease": (Lease(600), lambda e: signals(e, group_of(6), LEASE_KINDS)),
        "delivery": (Delivery(), lambda e: signals(e, group_of(8), DELIVERY_KINDS)),
        "workflow": (FLOW, lambda e: signals(e, F.col("user_id"), {k: k for k in ("view", "click", "purchase", "error", "signup")})),
    }[name]
    log, out, mark = (str(tmp_path / x) for x in ("log", "out", "mark"))
    e = spark.read.parquet(EVENTS)
    bounds = [0, 350, 700, e.count()]

    def follow(parts):
        for a, b in parts:
            e.where((F.col("event_id") >= a) & (F.col("event_id") < b)).coalesce(1).write.mode("append").parquet(log)
        source = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(log)
        kept(lens(source), policy).writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out).awaitTermination()

    pairs = list(zip(bounds, bounds[1:], strict=False))
    follow(pairs[:2])
    before = spark.read.parquet(out).count()
    follow(pairs[2:])
    got = spark.read.parquet(out)
    until = e.agg((F.max("ts") - F.expr("interval 1 hour")).cast("string")).first()[0]
    want = kept(lens(e), policy, until)
    assert 0 < before < got.count() == want.count()
    assert want.exceptAll(got).isEmpty()
    assert want.where("kind = 'timer'").count() > 20


def test_lease_rules(spark):
    second = lambda n: f"2024-01-01 00:{n // 60:02d}:{n % 60:02d}"
    log = lambda *kinds: spark.createDataFrame([("k", i, second(t), kind) for i, (t, kind) in enumerate(kinds)] + [(None, 1, second(1), "x"), ("k", 0, second(0), "consumed")], "key string, seq long, at string, kind string")
    after = lambda policy, *kinds, until=None: [(x.kind, x.after, x.attempts) for x in kept(log(*kinds), policy, until).orderBy("at", "seq").collect()]
    # A deferral gives its try back, a failure does not; the repeat of seq 0 does nothing.
    assert after(Lease(60), (0, "dispatched"), (5, "deferred"), (6, "dispatched"), (7, "failed"), (8, "consumed"), (9, "failed")) == [
        ("dispatched", "dispatched", 1), ("deferred", "pending", 0), ("dispatched", "dispatched", 1), ("failed", "pending", 1), ("consumed", "consumed", 1), ("failed", "consumed", 1)]
    # Five lapsed leases, and no sixth.
    lapsed = after(Lease(10), *[(20 * n, "dispatched") for n in range(6)], until=second(300))
    assert [x for x in lapsed if x[0] == "timer"] == [("timer", "lapsed", n) for n in range(1, 6)] and lapsed[-1] == ("dispatched", "lapsed", 5)
    # Waits of 10, 60 and 300 seconds; a try before its time is none.
    tries = after(Delivery(), (0, "error"), (5, "error"), (10, "error"), (71, "error"), (400, "ok"))
    assert tries == [("error", "waiting", 1), ("error", "waiting", 1), ("timer", "owed", 1), ("error", "waiting", 2), ("timer", "owed", 2), ("error", "waiting", 3), ("timer", "owed", 3), ("ok", "delivered", 4)]
    assert after(Delivery(), (0, "refused"), (1, "ok"), (2, "replay"), (3, "ok")) == [("refused", "dead", 1), ("ok", "dead", 1), ("replay", "owed", 0), ("ok", "delivered", 1)]
    flow = Workflow({"new": {"go": "wait"}, "wait": {"go": "end"}, "late": {"go": "wait"}}, {"wait": (30, "late")}, budget=3)
    assert after(flow, (0, "go"), (10, "stop"), (40, "go"), (80, "go")) == [("go", "wait", 1), ("stop", "wait", 1), ("timer", "late", 2), ("go", "wait", 3), ("timer", "errored", 3), ("go", "errored", 3)]
    assert kept(log(), Lease()).count() == 1 and kept(log().limit(0), Lease()).count() == 0


def test_folds_hold_one_state_for_a_hot_key(spark):
    """A key with most of the rows over many batches, others beside it, null among them; the fold sees each row once and in order."""
    rows = spark.range(60_000).select(F.when(F.col("id") % 100 < 90, 0).when(F.col("id") % 100 < 95, F.col("id") % 7).alias("key"), F.col("id").alias("at"))
    step = lambda s, r: ((s[0], s[1] + 1, s[2] and r["at"] > s[3], r["at"]), [])
    got = folded(rows, "key", ["at"], lambda k: (k, 0, True, -1), step, lambda s: [(s[0], s[1], s[2])], "key long, n long, ordered boolean").collect()
    want = {x.key: x.n for x in rows.groupBy("key").agg(F.count("*").alias("n")).collect()}
    assert {x.key: x.n for x in got} == want and all(x.ordered for x in got) and want[0] > 50_000
    assert folded(rows.limit(0), "key", ["at"], lambda k: (k, 0, True, -1), step, lambda s: [(s[0], s[1], s[2])], "key long, n long, ordered boolean").count() == 0
