"""Roll-ups: staircase, overview, tags, usage and credits."""

from pyspark.sql import functions as F

from memlake.operators.access import visible
from memlake.operators.running import running
from memlake.operators.usage import binding_limit, credits, token_bucket
from memlake.plans.lens import ITEMS_SQL, READER, items
from memlake.plans.registry import query, table

_STATE_SQL = "stated AS (SELECT s.*, CASE WHEN l.doc_id IS NOT NULL THEN 'enriched' WHEN s.n_chars >= 500 THEN 'searchable' ELSE 'stored' END AS state FROM seen s LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = s.data_id)"


def _stated(spark, sf_dir):
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("data_id")).distinct().withColumn("known", F.lit(True))
    state = F.when(F.col("known"), "enriched").when(F.col("n_chars") >= 500, "searchable").otherwise("stored")
    return items(spark, sf_dir).where(visible(READER)).join(known, "data_id", "left").withColumn("state", state)


@query(f"""WITH {ITEMS_SQL}, {_STATE_SQL} SELECT count(*) AS total, count_if(state = 'stored') AS stored, count_if(state = 'searchable') AS searchable,
  count_if(state = 'enriched') AS enriched, max(event_time) AS last_event FROM stated""")
def staircase(spark, sf_dir):
    state = lambda s: F.count_if(F.col("state") == s).alias(s)
    return _stated(spark, sf_dir).agg(F.count("*").alias("total"), state("stored"), state("searchable"), state("enriched"), F.max("event_time").alias("last_event"))


@query(f"""WITH {ITEMS_SQL} SELECT project_id, count(*) AS items, sum(n_chars)::BIGINT AS chars, min(event_time) AS first_event, max(event_time) AS last_event,
  count(DISTINCT owner_id) AS owners FROM seen GROUP BY 1""")
def overview_counts(spark, sf_dir):
    g = items(spark, sf_dir).where(visible(READER)).groupBy("project_id")
    return g.agg(F.count("*").alias("items"), F.sum("n_chars").alias("chars"), F.min("event_time").alias("first_event"), F.max("event_time").alias("last_event"), F.countDistinct("owner_id").alias("owners"))


@query(f"WITH {ITEMS_SQL} SELECT access_level, count(*) AS items FROM seen GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def overview_by_type(spark, sf_dir):
    return items(spark, sf_dir).where(visible(READER)).groupBy("access_level").agg(F.count("*").alias("items")).orderBy(F.desc("items"), "access_level").limit(8)


_WORDS_SQL = "words AS (SELECT data_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM seen)"


@query(f"WITH {ITEMS_SQL}, {_WORDS_SQL} SELECT word AS keyword, count(DISTINCT data_id) AS records FROM words WHERE length(word) > 3 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def keyword_counts(spark, sf_dir):
    """Records per keyword: each record's distinct words are exploded, so counts need no second distinct."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))
    each = items(spark, sf_dir).where(visible(READER)).select(F.explode(words).alias("keyword")).where(F.length("keyword") > 3)
    return each.groupBy("keyword").agg(F.count("*").alias("records")).orderBy(F.desc("records"), "keyword").limit(50)


@query(f"WITH {ITEMS_SQL} SELECT t AS tag, count(*) AS records FROM (SELECT unnest(shared_with) AS t FROM seen) GROUP BY 1")
def tag_counts(spark, sf_dir):
    return items(spark, sf_dir).where(visible(READER)).select(F.explode("shared_with").alias("tag")).groupBy("tag").agg(F.count("*").alias("records"))


_USAGE_SQL = """used AS (SELECT event_id, user_id, event_type, ts, (event_id * 37) % 2000 AS tokens_in, (event_id * 11) % 500 AS tokens_out, (event_id * 7) % 300 AS cached,
  event_type IN ('view', 'click') AS embeds FROM events),
costed AS (SELECT *, CASE WHEN tokens_in + tokens_out + cached <= 0 THEN 0 ELSE greatest(1, ceil(CASE WHEN embeds THEN tokens_in * 100 ELSE tokens_in * 1000 + tokens_out * 4000 + cached * 250 END / 1000000.0))::BIGINT END AS credits FROM used)"""


def _costed(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", (F.col("event_id") * 37 % 2000).alias("tokens_in"), (F.col("event_id") * 11 % 500).alias("tokens_out"), (F.col("event_id") * 7 % 300).alias("cached"))
    return e.withColumn("credits", credits(F.col("tokens_in"), F.col("tokens_out"), F.col("cached"), F.col("event_type").isin("view", "click")))


@query(f"WITH {_USAGE_SQL} SELECT event_id, credits FROM costed")
def credit_costs(spark, sf_dir):
    return _costed(spark, sf_dir).select("event_id", "credits")


@query(f"""WITH {_USAGE_SQL} SELECT event_type AS purpose, count(*) AS calls, sum(credits)::BIGINT AS credits, sum(tokens_in + tokens_out)::BIGINT AS tokens,
  count_if(credits > 2) AS crossed FROM costed GROUP BY 1""")
def usage_by_purpose(spark, sf_dir):
    g = _costed(spark, sf_dir).groupBy(F.col("event_type").alias("purpose"))
    return g.agg(F.count("*").alias("calls"), F.sum("credits").alias("credits"), F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("tokens"), F.count_if(F.col("credits") > 2).alias("crossed"))


@query(f"""WITH {_USAGE_SQL}, s AS (SELECT unnest(['org', 'project', 'user']) AS scope, unnest(['all', event_type, user_id::VARCHAR]) AS scope_id, ts::DATE AS day, credits FROM costed)
SELECT scope, scope_id, day, sum(credits)::BIGINT AS credits, count(*) AS calls FROM s GROUP BY 1, 2, 3""")
def daily_spend(spark, sf_dir):
    each = F.inline(F.array(*[F.struct(F.lit(s).alias("scope"), v.cast("string").alias("scope_id")) for s, v in (("org", F.lit("all")), ("project", F.col("event_type")), ("user", F.col("user_id")))]))
    return _costed(spark, sf_dir).select(each, F.to_date("ts").alias("day"), "credits").groupBy("scope", "scope_id", "day").agg(F.sum("credits").alias("credits"), F.count("*").alias("calls"))


@query("""SELECT c_custkey AS user_id, least(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 50 + 10 END, CASE WHEN c_nationkey % 4 = 0 THEN NULL ELSE c_nationkey * 3 END,
  CASE WHEN n_regionkey % 2 = 0 THEN NULL ELSE 40 + n_regionkey END)::BIGINT AS budget FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def budget_binding(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    own = F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") % 50 + 10)
    project = F.when(F.col("c_nationkey") % 4 != 0, F.col("c_nationkey").cast("long") * 3)
    org = F.when(F.col("n_regionkey") % 2 != 0, F.col("n_regionkey").cast("long") + 40)
    return rows.select(F.col("c_custkey").alias("user_id"), binding_limit(own, project, org).alias("budget"))


_BUCKET_SQL = f"""WITH RECURSIVE {_USAGE_SQL}, s AS (SELECT user_id AS key, event_id, ts, credits, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM costed),
f AS (SELECT DISTINCT key, 0::BIGINT AS i, 0::BIGINT AS event_id, false AS admitted, 0.0::DOUBLE AS level, NULL::TIMESTAMP AS before FROM s
  UNION ALL SELECT key, i, event_id, left_over + credits <= 20, CASE WHEN left_over + credits <= 20 THEN left_over + credits ELSE left_over END, ts FROM (
    SELECT s.key, s.i, s.event_id, s.credits, s.ts, CASE WHEN before IS NULL THEN level ELSE greatest(0.0::DOUBLE, level - (epoch_us(s.ts) - epoch_us(before)) / 1000000.0::DOUBLE / 3600 * 2.0::DOUBLE) END AS left_over
    FROM f JOIN s ON s.key = f.key AND s.i = f.i + 1))
SELECT key, event_id, admitted, round(level, 6) AS level FROM f WHERE i > 0"""


@query(_BUCKET_SQL)
def token_bucket_admission(spark, sf_dir):
    """Admission by a leaky bucket per user, folded in event order."""
    e = _costed(spark, sf_dir).select(F.col("user_id").alias("key"), "ts", "event_id", "credits")
    return token_bucket(e, capacity=20, per_hour=2.0)


@query("SELECT date_trunc('hour', ts) AS hour, count(*) AS questions, count(DISTINCT user_id) AS askers FROM events GROUP BY 1")
def hourly_counters(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("questions"), F.countDistinct("user_id").alias("askers"))


@query("""SELECT user_id, event_id AS last_run, event_type AS last_type, ok AS last_success FROM (
  SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r,
    max(CASE WHEN event_type <> 'error' THEN event_id END) OVER (PARTITION BY user_id) AS ok FROM events) WHERE r = 1""")
def latest_run_lateral(spark, sf_dir):
    """Last run and last success of each user by ordered aggregates, which combine before the shuffle."""
    last = F.struct("ts", "event_id")
    g = table(spark, sf_dir, "events").groupBy("user_id")
    return g.agg(F.max_by("event_id", last).alias("last_run"), F.max_by("event_type", last).alias("last_type"), F.max(F.when(F.col("event_type") != "error", F.col("event_id"))).alias("last_success"))


@query("""WITH e AS (SELECT event_type, value, ts, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events)
SELECT event_type, date_trunc('day', ts) AS day, count(*) AS on_time_or_late, sum(n)::BIGINT AS arrival_sum FROM e GROUP BY 1, 2""")
def late_data_event_time(spark, sf_dir):
    """Records are placed by event time whatever their order of arrival."""
    e = running(table(spark, sf_dir, "events").select("event_type", "event_id", "ts"), ["event_type"], ["event_id"])
    return e.groupBy("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("on_time_or_late"), F.sum("n").cast("long").alias("arrival_sum"))
