"""Queries of folds over ordered inputs."""

from pyspark.sql import functions as F

from memlake.plans.lens import MEMBERS_SQL, members
from memlake.plans.registry import query, table
from memlake.streaming.leases import BACKOFF, MAX_ATTEMPTS, Delivery, Lease, Workflow, kept
from memlake.streaming.machine import ORDER_LIFE, breaker, replay

#: What the log's events stand for: the life of an event of six signals, and of a delivery of eight.
LEASE_KINDS = {"view": "dispatched", "signup": "dispatched", "click": "deferred", "error": "failed", "purchase": "consumed"}
DELIVERY_KINDS = {"view": "error", "click": "error", "error": "error", "signup": "replay", "purchase": "ok"}
FLOW = Workflow({"new": {"signup": "open"}, "open": {"view": "open", "click": "active"}, "active": {"purchase": "done", "error": "open"}, "stale": {"signup": "open", "view": "open"}}, {"open": (86_400, "stale"), "active": (43_200, "stale")}, budget=12)
UNTIL = "2024-03-01"


def signals(events, key, kinds):
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.col("event_type"))
    return events.select(key.alias("key"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), kind.alias("kind"))


def group_of(n):
    return F.expr(f"event_id div {n}")


def _shown(rows):
    """Times as milliseconds."""
    return rows.select("key", "seq", F.unix_millis("at").alias("at_ms"), "kind", "before", "after", "attempts", F.unix_millis("due").alias("due_ms"))


def _keeper_sql(key: str, kinds: dict, start: str, fired: str, after: str, attempts: str, due: str, step: str = "0") -> str:
    """Signals of a key one after another over (status, attempts, due); the expressions see the state after overdue timers as b (status), n, and the signal as kind, t."""
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in kinds.items())
    return f"""WITH RECURSIVE s AS (SELECT ({key})::VARCHAR AS key, event_id AS seq, epoch_us(ts) // 1000 AS t, CASE event_type {cases} END AS kind,
  row_number() OVER (PARTITION BY {key} ORDER BY event_id) AS i FROM events),
f AS (SELECT key, 0::BIGINT AS i, NULL::BIGINT AS seq, NULL::BIGINT AS t, NULL::VARCHAR AS kind, NULL::VARCHAR AS before, '{start}' AS after, 0 AS attempts, NULL::BIGINT AS due, NULL::BIGINT AS fired_at, NULL::VARCHAR AS was, 0 AS fired_attempts, NULL::VARCHAR AS fired_to
  FROM (SELECT DISTINCT key FROM s)
  UNION ALL SELECT key, i, seq, t, kind, b, {after}, ({attempts})::INT, ({due})::BIGINT, fired_at, was, n, b FROM (
    SELECT s.*, f.after AS was, f.due AS fired_due, f.due IS NOT NULL AND f.due <= s.t AS late, CASE WHEN f.due <= s.t THEN f.due END AS fired_at,
      CASE WHEN f.due <= s.t THEN {fired} ELSE f.after END AS b, f.attempts + CASE WHEN f.due <= s.t THEN {step} ELSE 0 END AS n, CASE WHEN f.due <= s.t THEN NULL ELSE f.due END AS d
    FROM f JOIN s ON s.key = f.key AND s.i = f.i + 1)),
l AS (SELECT * FROM f QUALIFY i = max(i) OVER (PARTITION BY key))
SELECT key, seq, t AS at_ms, kind, before, after, attempts, due AS due_ms FROM f WHERE i > 0
UNION ALL SELECT key, NULL, fired_at, 'timer', was, fired_to, fired_attempts, NULL FROM f WHERE fired_at IS NOT NULL
UNION ALL SELECT key, NULL, due, 'timer', after, {fired.replace("f.", "l.")}, attempts + {step.replace("f.", "l.")}, NULL FROM l WHERE due <= epoch_ms(TIMESTAMP '{UNTIL}')"""


_LEASE_SQL = _keeper_sql(
    "event_id // 6", LEASE_KINDS, "pending", "'lapsed'",
    f"""CASE WHEN b IN ('consumed', 'failed') THEN b WHEN kind = 'dispatched' THEN CASE WHEN b IN ('pending', 'lapsed') AND n < {MAX_ATTEMPTS} THEN 'dispatched' ELSE b END
      WHEN kind = 'consumed' THEN 'consumed' WHEN kind = 'failed' THEN CASE WHEN n >= {MAX_ATTEMPTS} THEN 'failed' ELSE 'pending' END ELSE 'pending' END""",
    f"""CASE WHEN b IN ('consumed', 'failed') THEN n WHEN kind = 'dispatched' AND b IN ('pending', 'lapsed') AND n < {MAX_ATTEMPTS} THEN n + 1 WHEN kind = 'deferred' THEN greatest(n - 1, 0) ELSE n END""",
    f"""CASE WHEN b IN ('consumed', 'failed') THEN d WHEN kind = 'dispatched' THEN CASE WHEN b IN ('pending', 'lapsed') AND n < {MAX_ATTEMPTS} THEN t + 600000 ELSE d END END""",
)


@query(_LEASE_SQL)
def event_leases(spark, sf_dir):
    """Events of the log as leased work: dispatched, consumed, failed, given back, lapsed."""
    return _shown(kept(signals(table(spark, sf_dir, "events"), group_of(6), LEASE_KINDS), Lease(600), UNTIL))


_DELIVERY_SQL = _keeper_sql(
    "event_id // 8", DELIVERY_KINDS, "owed", "'owed'",
    f"""CASE WHEN kind = 'replay' THEN CASE WHEN b = 'dead' THEN 'owed' ELSE b END WHEN b <> 'owed' THEN b WHEN kind = 'ok' THEN 'delivered' WHEN n + 1 >= {MAX_ATTEMPTS} THEN 'dead' ELSE 'waiting' END""",
    "CASE WHEN kind = 'replay' THEN CASE WHEN b = 'dead' THEN 0 ELSE n END WHEN b <> 'owed' THEN n ELSE n + 1 END",
    f"""CASE WHEN kind = 'replay' THEN CASE WHEN b <> 'dead' THEN d END WHEN b <> 'owed' THEN d WHEN kind <> 'ok' AND n + 1 < {MAX_ATTEMPTS} THEN t + 1000 * {list(BACKOFF)}[least(n + 1, {len(BACKOFF)})] END""",
)


@query(_DELIVERY_SQL)
def delivery_retries(spark, sf_dir):
    """Deliveries tried, waiting, owed again when their wait is over, dead and re-armed."""
    return _shown(kept(signals(table(spark, sf_dir, "events"), group_of(8), DELIVERY_KINDS), Delivery(), UNTIL))


def inputs(events):
    return events.select(F.col("user_id").alias("instance"), F.col("event_id").alias("seq"), F.col("event_type").alias("input"), F.when(F.col("event_id") % 3 == 0, "guest").otherwise("buyer").alias("actor"))


_MOVES = [(a, k, b, who) for a, kinds in ORDER_LIFE.items() for k, (b, who) in kinds.items()]
_REPLAY_SQL = f"""WITH RECURSIVE m(at_state, input, target, who) AS (VALUES {", ".join(f"('{a}', '{k}', '{b}', {str(list(who)) + '::VARCHAR[]'})" for a, k, b, who in _MOVES)}),
s AS (SELECT user_id AS instance, event_id AS seq, event_type AS input, CASE WHEN event_id % 3 = 0 THEN 'guest' ELSE 'buyer' END AS actor, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (SELECT DISTINCT instance, 0::BIGINT AS i, -1::BIGINT AS seq, '' AS input, '' AS from_state, 'new' AS to_state, '' AS outcome, 0 AS spent FROM s
  UNION ALL SELECT instance, i, seq, input, from_state, CASE WHEN outcome = 'applied' THEN target ELSE from_state END, outcome, spent + (outcome = 'applied')::INT FROM (
    SELECT s.instance, s.i, s.seq, s.input, f.to_state AS from_state, target, spent,
      CASE WHEN target IS NULL THEN 'no_transition' WHEN len(who) > 0 AND NOT list_contains(who, actor) THEN 'actor_refused' WHEN spent >= 20 THEN 'budget_spent' ELSE 'applied' END AS outcome
    FROM f JOIN s ON s.instance = f.instance AND s.i = f.i + 1 LEFT JOIN m ON at_state = f.to_state AND m.input = s.input))
SELECT instance, seq, input, from_state, to_state, outcome FROM f WHERE i > 0"""


@query(_REPLAY_SQL)
def workflow_replay(spark, sf_dir):
    return replay(inputs(table(spark, sf_dir, "events")), ORDER_LIFE, budget=20)


_FLOW_CASES = " ".join(f"WHEN b = '{a}' AND kind = '{k}' THEN '{b}'" for a, ways in FLOW.moves.items() for k, b in ways.items())
_FLOW_NEXT = f"(CASE {_FLOW_CASES} END)"
_FLOW_SQL = _keeper_sql(
    "user_id", {k: k for k in ("view", "click", "purchase", "error", "signup")}, "new", f"CASE WHEN f.attempts >= {FLOW.budget} THEN 'errored' ELSE 'stale' END",
    f"CASE WHEN {_FLOW_NEXT} IS NULL THEN b WHEN n >= {FLOW.budget} THEN 'errored' ELSE {_FLOW_NEXT} END",
    f"CASE WHEN {_FLOW_NEXT} IS NULL OR n >= {FLOW.budget} THEN n ELSE n + 1 END",
    f"CASE WHEN {_FLOW_NEXT} IS NULL THEN d WHEN n >= {FLOW.budget} THEN NULL WHEN {_FLOW_NEXT} = 'open' THEN t + 86400000 WHEN {_FLOW_NEXT} = 'active' THEN t + 43200000 END", f"(f.attempts < {FLOW.budget})::INT",
)


@query(_FLOW_SQL)
def workflow_deadlines(spark, sf_dir):
    """Instances moved by inputs and, where their state's deadline passes first, by the clock; a cycle ends with its budget."""
    kinds = {k: k for k in ("view", "click", "purchase", "error", "signup")}
    return _shown(kept(signals(table(spark, sf_dir, "events"), F.col("user_id"), kinds), FLOW, UNTIL))


@query()
def breaker_states(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("engine"), F.col("event_id").alias("seq"), "ts", (F.col("event_type") != "error").alias("ok"))
    return breaker(e, failures=2, rest_s=36_000)


@query(f"""WITH {MEMBERS_SQL} SELECT memory_id, min_by(seq, seq) AS from_seq, max(seq) AS to_seq, min_by(coalesce(text, ''), seq) <> max_by(coalesce(text, ''), seq) AS differs,
  max_by(length(coalesce(text, '')), seq) - min_by(length(coalesce(text, '')), seq) AS grown FROM members GROUP BY 1""")
def net_between(spark, sf_dir):
    """The net change from the first checkpoint to the last, whatever happened between."""
    text = F.coalesce("text", F.lit(""))
    g = members(spark, sf_dir).groupBy("memory_id").agg(F.min("seq").alias("from_seq"), F.max("seq").alias("to_seq"), F.min_by(F.sha2(text, 256), "seq").alias("a"), F.max_by(F.sha2(text, 256), "seq").alias("b"), (F.max_by(F.length(text), "seq") - F.min_by(F.length(text), "seq")).alias("grown"))
    return g.select("memory_id", "from_seq", "to_seq", (F.col("a") != F.col("b")).alias("differs"), F.col("grown").cast("long").alias("grown"))


@query("""WITH l AS (SELECT user_id AS instance, max_by(event_type, event_id) AS state, max(ts) AS entered FROM events GROUP BY 1)
SELECT instance, state FROM l WHERE state IN ('view', 'click') AND entered + INTERVAL 12 HOUR <= TIMESTAMP '2024-01-31'""")
def timeouts_due(spark, sf_dir):
    """Instances whose state has a deadline that has passed."""
    last = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("instance")).agg(F.max_by("event_type", "event_id").alias("state"), F.max("ts").alias("entered"))
    due = F.col("entered") + F.expr("interval 12 hours") <= F.lit("2024-01-31").cast("timestamp_ntz")
    return last.where(F.col("state").isin("view", "click") & due).select("instance", "state")
