"""Event-log queries in batch form."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from memlake.functions.selectors import compile_selector
from memlake.operators.access import visible
from memlake.plans.lens import ITEMS_SQL, MEMBERS_SQL, READER, items, members
from memlake.plans.registry import query, table
from memlake.streaming.events import as_of, delivery_state, evaluate_gap, new_matches, timeline, verify_machine

SELECTOR = {"k": {"op": "gt", "value": 20}, "missing": {"op": "exists", "value": False}}
_SELECTOR_SQL = "coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) > 20, false)"


def _log(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumnsRenamed({"event_id": "sequence", "event_type": "surface"})


@query(f"SELECT event_id AS sequence FROM events WHERE event_type = 'error' AND {_SELECTOR_SQL}")
def alert_selector(spark, sf_dir):
    return _log(spark, sf_dir).where((F.col("surface") == "error") & compile_selector(SELECTOR, F.col("props"))).select("sequence")


@query(f"""WITH s AS (SELECT * FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 500)
SELECT count_if(event_type = 'error') AS candidates, count_if(event_type = 'error' AND {_SELECTOR_SQL}) AS matches, max(event_id) AS watermark,
  (SELECT greatest(count(*) - 500, 0) FROM events WHERE event_id > 100) AS deferred FROM s""")
def alert_gap(spark, sf_dir):
    return evaluate_gap(_log(spark, sf_dir), 100, 500, "error", compile_selector(SELECTOR, F.col("props")))


@query(f"SELECT event_type AS surface, count(*) AS candidates, count_if({_SELECTOR_SQL}) AS matches FROM events GROUP BY 1")
def alert_backtest(spark, sf_dir):
    return _log(spark, sf_dir).groupBy("surface").agg(F.count("*").alias("candidates"), F.count_if(compile_selector(SELECTOR, F.col("props"))).alias("matches"))


@query(f"""WITH {ITEMS_SQL}, a AS (SELECT event_id AS sequence, event_id % 1000 AS data_id FROM events WHERE event_id > 200)
SELECT data_id, min(sequence) AS sequence, data_id NOT IN (SELECT data_id FROM seen) AS withheld FROM a JOIN items USING (data_id)
WHERE NOT deleted AND regexp_matches(lower(text), '(^|[^a-z0-9])(and|the)([^a-z0-9]|$)') GROUP BY 1""")
def standing_arrival(spark, sf_dir):
    """Arrivals after the watermark whose record matches; those that the owner may not see are counted, not shown."""
    arrived = _log(spark, sf_dir).where("sequence > 200").select("sequence", (F.col("sequence") % 1000).alias("data_id")).groupBy("data_id").agg(F.min("sequence").alias("sequence"))
    match = items(spark, sf_dir).where(~F.col("deleted") & F.lower("text").rlike("(^|[^a-z0-9])(and|the)([^a-z0-9]|$)"))
    return arrived.join(match, "data_id").select("data_id", "sequence", (~visible(READER)).alias("withheld"))


@query(f"""WITH {ITEMS_SQL} SELECT data_id, event_time FROM seen WHERE event_time >= TIMESTAMP '2024-01-10' + INTERVAL 2 DAY - INTERVAL 12 HOUR
  AND event_time < TIMESTAMP '2024-01-10' + INTERVAL 2 DAY + INTERVAL 12 HOUR""")
def standing_date(spark, sf_dir):
    """Records whose date lies within half a day of two days from now; now is a parameter."""
    due = F.lit("2024-01-10").cast("timestamp_ntz") + F.expr("interval 2 days")
    half = F.expr("interval 12 hours")
    return items(spark, sf_dir).where(visible(READER) & (F.col("event_time") >= due - half) & (F.col("event_time") < due + half)).select("data_id", "event_time")


@query("""SELECT q, data_id, count(*) AS seen FROM (SELECT event_id % 5 AS q, event_id % 97 AS data_id FROM events WHERE event_id >= 300) e
  WHERE NOT EXISTS (SELECT 1 FROM events p WHERE p.event_id < 300 AND p.event_id % 5 = e.q AND p.event_id % 97 = e.data_id) GROUP BY 1, 2""")
def match_log_idempotent(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 5).alias("q"), (F.col("event_id") % 97).alias("data_id"))
    later = e.where("event_id >= 300")
    fresh = new_matches(later, e.where("event_id < 300"), ["q", "data_id"]).select("q", "data_id")
    return later.join(fresh, ["q", "data_id"], "left_semi").groupBy("q", "data_id").agg(F.count("*").alias("seen"))


_TIMELINE_SQL = f"""{MEMBERS_SQL}, c AS (SELECT memory_id, seq AS turn, added_at, sha256(coalesce(text, '')) AS checksum, CASE WHEN seq % 5 = 4 THEN 'g2' ELSE 'g1' END AS generator FROM members),
t AS (SELECT *, row_number() OVER w AS seq, CASE WHEN row_number() OVER w = 1 THEN 'first' WHEN lag(checksum) OVER w = checksum THEN 'unchanged'
  WHEN lag(generator) OVER w <> generator THEN 'incomparable' ELSE 'changed' END AS outcome FROM c WINDOW w AS (PARTITION BY memory_id ORDER BY turn))"""


def _timeline(spark, sf_dir):
    m = members(spark, sf_dir).withColumnRenamed("seq", "turn").withColumn("generator", F.when(F.col("turn") % 5 == 4, "g2").otherwise("g1"))
    return timeline(m, "memory_id", "turn")


@query(f"WITH {_TIMELINE_SQL} SELECT memory_id, seq::INT AS seq, checksum, outcome FROM t")
def checkpoint_timeline(spark, sf_dir):
    return _timeline(spark, sf_dir).select("memory_id", "seq", "checksum", "outcome")


@query(f"""WITH {_TIMELINE_SQL}, p AS (SELECT memory_id, max(seq) AS upto FROM t WHERE added_at <= TIMESTAMP '2024-01-01 18:00:00' GROUP BY 1)
SELECT memory_id, upto::INT AS upto, count_if(seq <= upto AND outcome = 'changed') AS changes, count_if(seq <= upto AND outcome = 'incomparable') AS gaps FROM t JOIN p USING (memory_id) GROUP BY 1, 2""")
def changes_between(spark, sf_dir):
    """Changes and gaps from the first checkpoint to the one in force at a time (as-of)."""
    t = _timeline(spark, sf_dir)
    probes = t.select("memory_id").distinct().withColumn("at", F.lit("2024-01-01 18:00:00").cast("timestamp_ntz"))
    upto = as_of(t, probes, "memory_id", "added_at", "at").select("memory_id", F.col("seq").alias("upto"))
    within = lambda o: F.count_if((F.col("seq") <= F.col("upto")) & (F.col("outcome") == o))
    return t.join(upto, "memory_id").groupBy("memory_id", "upto").agg(within("changed").alias("changes"), within("incomparable").alias("gaps"))


_MACHINE_SQL = """m AS (SELECT user_id AS instance, event_id, event_type AS to_state, row_number() OVER w + CASE WHEN user_id % 7 = 0 AND row_number() OVER w > 2 THEN 1 ELSE 0 END AS seq,
  CASE WHEN event_id % 29 = 0 THEN 'lost' ELSE coalesce(lag(event_type) OVER w, 'new') END AS from_state FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"""


@query(f"""WITH {_MACHINE_SQL}, v AS (SELECT *, coalesce(seq - lag(seq) OVER w <> 1, seq <> 1) AS gap, coalesce(lag(to_state) OVER w <> from_state, false) AS broken FROM m WINDOW w AS (PARTITION BY instance ORDER BY seq))
SELECT instance, count(*) AS transitions, count_if(gap) AS gaps, count_if(broken) AS breaks, count_if(gap OR broken) = 0 AS agrees FROM v GROUP BY 1""")
def workflow_verify(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    n = F.row_number().over(w)
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("instance"), F.col("event_type").alias("to_state"), (n + F.when((F.col("user_id") % 7 == 0) & (n > 2), 1).otherwise(0)).alias("seq"), F.when(F.col("event_id") % 29 == 0, "lost").otherwise(F.coalesce(F.lag("event_type").over(w), F.lit("new"))).alias("from_state"))
    return verify_machine(e)


@query("""WITH a AS (SELECT event_id // 4 AS delivery, event_id % 4 = 3 AND event_id % 3 = 0 AS ok, ts AS tried FROM events),
g AS (SELECT delivery, count(*) AS tries, bool_or(ok) AS ok, max(tried) AS tried FROM a GROUP BY 1)
SELECT delivery, tries, CASE WHEN ok THEN 'delivered' WHEN tries > 4 THEN 'dead' ELSE 'pending' END AS state,
  CASE WHEN NOT ok AND tries <= 4 THEN tried + to_seconds([10, 60, 300, 1800][tries]) END AS next_attempt FROM g""")
def outbox_state(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return delivery_state(e.select(F.floor(F.col("event_id") / 4).alias("delivery"), ((F.col("event_id") % 4 == 3) & (F.col("event_id") % 3 == 0)).alias("ok"), F.col("ts").alias("at")))


@query("""SELECT page_id, url FROM pages p WHERE NOT EXISTS (SELECT 1 FROM pages s WHERE s.page_id < 100 AND s.url = p.url AND md5(s.html) = md5(p.html)) AND page_id >= 50""")
def crawl_dedupe(spark, sf_dir):
    """Discovered pages that were not seen in the same version before."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.md5("html").alias("version"))
    return p.where("page_id >= 50").join(p.where("page_id < 100").select("url", "version"), ["url", "version"], "left_anti").select("page_id", "url")


@query("""SELECT event_type AS crawler, max(CASE WHEN value >= 50 THEN ts END) AS last_ok, floor(epoch(TIMESTAMP '2024-12-31' - max(CASE WHEN value >= 50 THEN ts END)))::BIGINT AS lag_s FROM events GROUP BY 1 ORDER BY lag_s NULLS FIRST""")
def source_lag(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("crawler")).agg(F.max(F.when(F.col("value") >= 50, F.col("ts"))).alias("last_ok"))
    lag = F.floor(F.unix_timestamp(F.lit("2024-12-31").cast("timestamp")) - F.unix_micros(F.col("last_ok").cast("timestamp")) / 1_000_000).cast("long")
    return g.withColumn("lag_s", lag).orderBy(F.asc_nulls_first("lag_s"))


@query("""SELECT e.event_id AS sequence FROM events e LEFT JOIN events p ON p.event_id = e.event_id - 7 WHERE e.event_type <> 'view' AND (p.event_id IS NULL OR p.event_type = 'view')
  AND e.event_id % 6 < 5 ORDER BY 1 LIMIT 500""")
def dispatch_ready(spark, sf_dir):
    """Pending events whose parent is consumed (or that have none), with attempts left, by sequence."""
    e = table(spark, sf_dir, "events")
    parent = e.select((F.col("event_id") + 7).alias("event_id"), F.col("event_type").alias("parent"))
    ready = (F.col("event_type") != "view") & (F.col("parent").isNull() | (F.col("parent") == "view")) & (F.col("event_id") % 6 < 5)
    return e.join(parent, "event_id", "left").where(ready).select(F.col("event_id").alias("sequence")).orderBy("sequence").limit(500)
