"""Facts seen through evidence, three-armed retrieval, routing."""

from pyspark.sql import functions as F

from memlake.functions.names import normalize_name
from memlake.operators.access import LEVELS, visible
from memlake.operators.evidence import drawn_under, from_source, history, known_at, readable, seeds, visible_facts, walk
from memlake.operators.retrieval import Filter, fuse, graph_arm, narrowed, over_fetch
from memlake.operators.routing import fan_out, poll, route
from memlake.plans.lens import ITEMS_SQL, READER, items
from memlake.plans.registry import query, table
from memlake.plans.retrieval_queries import _LEXICAL_SQL, _VECTOR_SQL, LIMIT, _lexical, _vector

VALID, RECORDED = "1996-07-01", "1997-01-01"
QUESTION = " and ".join(f"customer {i:09d}" for i in range(1, 41))
NARROW = Filter(tags=("t1", "t2", "t3"), memories=tuple(f"m{i}" for i in range(25)), keywords=("k0", "k1", "k2"), entities=("p1", "p2"), since="2024-01-01 05:00:00", until="2034-01-01")

#: An order is evidence, in the record of its fifteen, that its customer uses its priority; some facts are asserted with a level of their own.
_FACTS_SQL = f"""{ITEMS_SQL},
evidence AS (SELECT o_custkey || ':' || left(o_orderpriority, 1) AS fact_id, o_orderkey // 15 AS data_id, o_orderkey, o_custkey AS k, left(o_orderpriority, 1) AS p, o_orderdate,
  CASE o_orderkey % 3 WHEN 0 THEN 'scripture' WHEN 1 THEN 'incident' END AS template FROM orders),
facts AS (SELECT *, valid_from + INTERVAL 30 DAY AS recorded_at, CASE WHEN k % 4 = 0 THEN valid_from + INTERVAL 365 DAY END AS valid_to, CASE WHEN k % 6 = 0 THEN valid_from + INTERVAL 700 DAY END AS retracted_at,
  CASE WHEN k % 10 = 0 THEN 'asserted' ELSE 'derived' END AS basis, 'u' || (k % 7) AS owner_id, ['private','restricted','shared','org','public'][(k // 10 % 5 + 1)::INT] AS access_level,
  ['user:u' || (k % 3), 'group:g' || (k // 10 % 2)] AS shared_with FROM (SELECT fact_id, k, 'c' || k AS subject, 'p' || p AS object, min(o_orderdate) AS valid_from FROM evidence GROUP BY fact_id, k, p)),
readable AS (SELECT * FROM evidence WHERE data_id IN (SELECT data_id FROM seen)),
backed AS (SELECT fact_id, count(DISTINCT data_id) AS evidence FROM readable GROUP BY 1),
held AS (SELECT f.*, coalesce(b.evidence, 0) AS evidence FROM facts f LEFT JOIN backed b USING (fact_id) WHERE (basis = 'derived' AND b.evidence IS NOT NULL) OR (basis = 'asserted' AND k % 170 <> 0 AND (
  access_level IN ('org','public') OR (access_level IN ('private','shared') AND owner_id = 'u1') OR (access_level IN ('shared','restricted') AND list_has_any(shared_with, ['user:u1','group:g0']))))),
live AS (SELECT * FROM held WHERE valid_from <= TIMESTAMP '{VALID}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{VALID}')
  AND recorded_at <= TIMESTAMP '{RECORDED}' AND (retracted_at IS NULL OR retracted_at > TIMESTAMP '{RECORDED}')),
named AS (SELECT 'c' || k AS id, data_id FROM readable UNION SELECT 'p' || p, data_id FROM readable),
steps AS (SELECT subject AS a, object AS b FROM live UNION SELECT object, subject FROM live)"""
_WALK_SQL = """walk(id, hops) AS (SELECT id, 0 FROM (SELECT DISTINCT id FROM named WHERE id = 'p1') UNION SELECT b, hops + 1 FROM walk JOIN steps ON a = id WHERE hops < 2),
nodes AS (SELECT id, min(hops)::INT AS hops FROM walk WHERE id IN (SELECT id FROM named) GROUP BY 1)"""
_SEEDS_SQL = f"""entities AS (SELECT 'c' || c_custkey AS id, replace(lower(c_name), '#', ' ') AS name FROM customer),
seeds AS (SELECT id, name FROM entities WHERE length(name) >= 3 AND contains('{QUESTION}', name) AND id IN (SELECT id FROM named) ORDER BY length(name) DESC, id LIMIT 8)"""
_GRAPH_SQL = """reached AS (SELECT id, min(hops) AS hops FROM (SELECT id, 0 AS hops FROM seeds UNION ALL SELECT b, 1 FROM steps JOIN seeds ON a = id) WHERE id IN (SELECT id FROM named) GROUP BY 1),
graph AS (SELECT data_id, hops, mentions, row_number() OVER (ORDER BY hops, mentions DESC, data_id) AS rank FROM (
  SELECT data_id, min(hops) AS hops, count(*) AS mentions FROM named JOIN reached USING (id) GROUP BY 1) QUALIFY rank <= 40)"""


def _evidence(spark, sf_dir):
    o, p = table(spark, sf_dir, "orders"), F.substring("o_orderpriority", 1, 1)
    lens = F.when(F.col("o_orderkey") % 3 == 0, "scripture").when(F.col("o_orderkey") % 3 == 1, "incident")
    return o.select(F.concat("o_custkey", F.lit(":"), p).alias("fact_id"), F.expr("o_orderkey div 15").alias("data_id"), "o_orderkey", F.col("o_custkey").alias("k"), p.alias("p"), "o_orderdate", lens.alias("template"))


def _facts(spark, sf_dir):
    g = _evidence(spark, sf_dir).groupBy("fact_id", "k", "p").agg(F.min("o_orderdate").alias("valid_from"))
    later = lambda days: F.col("valid_from") + F.expr(f"INTERVAL {days} DAYS")
    tens = F.expr("k div 10")
    return g.select(
        "fact_id", F.concat(F.lit("c"), "k").alias("subject"), F.concat(F.lit("p"), "p").alias("object"), "valid_from",
        F.when(F.col("k") % 4 == 0, later(365)).alias("valid_to"), later(30).alias("recorded_at"), F.when(F.col("k") % 6 == 0, later(700)).alias("retracted_at"),
        F.when(F.col("k") % 10 == 0, "asserted").otherwise("derived").alias("basis"), F.lit("en").alias("org_id"), F.concat(F.lit("u"), F.col("k") % 7).alias("owner_id"),
        F.get(F.array(*[F.lit(x) for x in LEVELS]), (tens % 5).cast("int")).alias("access_level"),
        F.array(F.concat(F.lit("user:u"), F.col("k") % 3), F.concat(F.lit("group:g"), tens % 2)).alias("shared_with"), (F.col("k") % 170 == 0).alias("deleted"),
    )


def _seen(spark, sf_dir):
    return readable(_evidence(spark, sf_dir), items(spark, sf_dir), READER)


def _held(spark, sf_dir):
    return visible_facts(_facts(spark, sf_dir), _seen(spark, sf_dir), READER)


def _live(spark, sf_dir):
    at = lambda day: F.lit(day).cast("timestamp_ntz")
    return _held(spark, sf_dir).where(known_at(at(VALID), at(RECORDED)))


def _named(spark, sf_dir):
    """Entities and the readable records that mention them."""
    both = F.explode(F.array(F.concat(F.lit("c"), "k"), F.concat(F.lit("p"), "p"))).alias("id")
    return _seen(spark, sf_dir).select(both, "data_id").distinct()


def _walked(spark, sf_dir):
    return walk(_live(spark, sf_dir), _named(spark, sf_dir), spark.createDataFrame([("p1",)], "id string"), 2)


def _seeded(spark, sf_dir):
    entities = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), normalize_name(F.col("c_name")).alias("name"))
    return seeds(entities, _named(spark, sf_dir), QUESTION)


def _graph(spark, sf_dir):
    named = _named(spark, sf_dir)
    reached, _ = walk(_live(spark, sf_dir), named, _seeded(spark, sf_dir).select("id"), 1)
    return graph_arm(reached, named, items(spark, sf_dir).where(visible(READER)), over_fetch(LIMIT))


@query(f"WITH {_FACTS_SQL} SELECT fact_id, basis, evidence FROM held")
def facts_visible(spark, sf_dir):
    return _held(spark, sf_dir).select("fact_id", "basis", "evidence")


@query(f"WITH {_FACTS_SQL} SELECT fact_id, subject, object, valid_from, recorded_at FROM live")
def facts_bitemporal(spark, sf_dir):
    return _live(spark, sf_dir).select("fact_id", "subject", "object", "valid_from", "recorded_at")


@query(f"WITH {_FACTS_SQL} SELECT fact_id FROM held WHERE fact_id IN (SELECT fact_id FROM readable WHERE template = 'scripture')")
def facts_under_template(spark, sf_dir):
    return drawn_under(_held(spark, sf_dir), _seen(spark, sf_dir), "scripture").select("fact_id")


@query(f"WITH {_FACTS_SQL} SELECT fact_id FROM held WHERE fact_id IN (SELECT fact_id FROM readable WHERE data_id IN (SELECT doc_id FROM documents WHERE doc_id % 50 < 10))")
def facts_from_memory(spark, sf_dir):
    """Facts that the records of a memory support; the memory holds a fifth of the records."""
    members = table(spark, sf_dir, "documents").where("doc_id % 50 < 10").select(F.col("doc_id").alias("data_id"))
    return from_source(_held(spark, sf_dir), _seen(spark, sf_dir), members=members).select("fact_id")


@query(f"WITH RECURSIVE {_FACTS_SQL}, {_WALK_SQL} SELECT id, hops FROM nodes")
def walk_nodes(spark, sf_dir):
    return _walked(spark, sf_dir)[0]


@query(f"WITH RECURSIVE {_FACTS_SQL}, {_WALK_SQL} SELECT fact_id, evidence FROM live WHERE subject IN (SELECT id FROM nodes) AND object IN (SELECT id FROM nodes)")
def walk_facts(spark, sf_dir):
    return _walked(spark, sf_dir)[1].select("fact_id", "evidence")


@query(f"WITH {_FACTS_SQL} SELECT fact_id, subject, object, valid_from, valid_to, recorded_at, retracted_at, evidence FROM held WHERE subject = 'p1' OR object = 'p1'")
def fact_history(spark, sf_dir):
    return history(_held(spark, sf_dir), "p1").select("fact_id", "subject", "object", "valid_from", "valid_to", "recorded_at", "retracted_at", "evidence")


@query(f"WITH {_FACTS_SQL}, {_SEEDS_SQL} SELECT id, name FROM seeds")
def graph_seeds(spark, sf_dir):
    return _seeded(spark, sf_dir)


@query(f"""WITH {_FACTS_SQL}, {_SEEDS_SQL}, {_GRAPH_SQL} SELECT data_id, hops, mentions, CASE WHEN hops = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS score, rank::INT AS rank FROM graph""")
def graph_records(spark, sf_dir):
    """The graph arm over visible facts: records that mention a seed or what it is related to."""
    return _graph(spark, sf_dir)


@query(f"""WITH {_FACTS_SQL}, {_VECTOR_SQL}, {_LEXICAL_SQL}, {_SEEDS_SQL}, {_GRAPH_SQL}, fused AS (
  SELECT data_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, string_agg(arm, ',' ORDER BY arm) AS arms FROM (
    SELECT data_id, rank, 'vector' AS arm FROM vector UNION ALL SELECT data_id, rank, 'lexical' FROM lexical UNION ALL SELECT data_id, rank, 'graph' FROM graph) GROUP BY 1)
SELECT data_id, score, arms, row_number() OVER (ORDER BY score DESC, data_id)::INT AS rank FROM fused QUALIFY rank <= 10""")
def three_arm_fusion(spark, sf_dir):
    arms = {"vector": _vector(spark, sf_dir), "lexical": _lexical(spark, sf_dir), "graph": _graph(spark, sf_dir)}
    return fuse(arms, LIMIT).where(F.col("rank") <= LIMIT)


@query(f"""WITH {_FACTS_SQL} SELECT data_id FROM seen WHERE data_id % 5 IN (1, 2, 3) AND data_id % 50 < 25 AND data_id % 4 < 3
  AND event_time BETWEEN TIMESTAMP '{NARROW.since}' AND TIMESTAMP '{NARROW.until}' AND data_id IN (SELECT data_id FROM evidence WHERE p IN ('1', '2'))""")
def retrieval_narrowed(spark, sf_dir):
    """A search narrowed by tags, memories, artifact keywords, entities and time."""
    key = lambda prefix, n: F.concat(F.lit(prefix), F.col("data_id") % n)
    records = items(spark, sf_dir).where(visible(READER)).withColumn("tags", F.array(key("t", 5))).withColumn("template", F.lit(None).cast("string"))
    every = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("data_id"))
    members, artifacts = every.select("data_id", key("m", 50).alias("memory_id")), every.select("data_id", F.array(key("k", 4)).alias("keywords"))
    mentions = _evidence(spark, sf_dir).select(F.concat(F.lit("p"), "p").alias("entity"), "data_id")
    return narrowed(records, NARROW, members, artifacts, mentions).select("data_id")


@query("""SELECT o_orderkey AS data_id, CASE WHEN o_custkey % 3 = 0 THEN 'thread' WHEN o_orderkey % 4 <> 1 THEN 'default' END AS type,
  CASE WHEN o_custkey % 3 = 0 THEN 'k' || o_custkey WHEN o_orderkey % 4 <> 1 THEN CASE WHEN o_custkey % 2 = 0 THEN o_orderpriority ELSE 'u' || (o_custkey % 7) END END AS memory_key,
  CASE WHEN o_custkey % 3 = 0 OR (o_orderkey % 4 <> 1 AND o_custkey % 2 = 1) THEN 'u' || (o_custkey % 7) END AS owner_id,
  CASE WHEN o_custkey % 3 = 0 THEN 'explicit' WHEN o_orderkey % 4 <> 1 THEN 'routed' END AS provenance FROM orders""")
def memory_routing(spark, sf_dir):
    o, asked = table(spark, sf_dir, "orders"), F.col("o_custkey") % 3 == 0
    writes = o.select(
        F.col("o_orderkey").alias("data_id"), F.col("o_orderpriority").alias("project_id"), F.concat(F.lit("u"), F.col("o_custkey") % 7).alias("owner_id"),
        F.when(F.col("o_custkey") % 2 == 0, "shared").otherwise("personal").alias("scope"), F.when(asked, "thread").alias("asked_type"), F.when(asked, F.concat(F.lit("k"), "o_custkey")).alias("asked_key"),
    )
    return route(writes, o.where("o_orderkey % 4 = 1").select(F.col("o_orderkey").alias("data_id")))


@query(f"""WITH {_FACTS_SQL} SELECT o_orderkey AS sequence, CASE WHEN o_orderkey % 3 = 0 THEN fact_id END AS fact_id, CASE WHEN o_orderkey % 3 = 1 THEN data_id END AS data_id, CASE WHEN o_orderkey % 3 = 2 THEN data_id // 10 END AS memory_id
  FROM evidence WHERE o_orderkey > 100 AND ((o_orderkey % 3 = 0 AND fact_id IN (SELECT fact_id FROM held)) OR (o_orderkey % 3 = 1 AND data_id IN (SELECT data_id FROM seen))
    OR (o_orderkey % 3 = 2 AND data_id // 10 IN (SELECT data_id // 10 FROM seen))) ORDER BY 1 LIMIT 500""")
def poll_feed(spark, sf_dir):
    """A page of the feed after a cursor: events about facts, records and memories that the reader may see."""
    turn = lambda i, c: F.when(F.col("o_orderkey") % 3 == i, c)
    memory = F.expr("data_id div 10")
    observed = _evidence(spark, sf_dir).select(F.col("o_orderkey").alias("sequence"), turn(0, F.col("fact_id")).alias("fact_id"), turn(1, F.col("data_id")).alias("data_id"), turn(2, memory).alias("memory_id"))
    records = items(spark, sf_dir).where(visible(READER)).select("data_id")
    return poll(observed, _held(spark, sf_dir), records, records.select(memory.alias("memory_id")), 100, 500)


@query("""WITH m AS (SELECT event_id, user_id % 5 AS project_id, user_id % 20 AS alert_id FROM events),
s AS (SELECT n_nationkey AS subscription_id, n_nationkey % 5 AS project_id, CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey % 20 END AS alert_id FROM nation WHERE n_nationkey % 7 <> 0)
SELECT DISTINCT subscription_id, event_id FROM m JOIN s ON m.project_id = s.project_id AND (s.alert_id IS NULL OR s.alert_id = m.alert_id) WHERE event_id % 11 <> subscription_id % 11""")
def delivery_fanout(spark, sf_dir):
    e, n = table(spark, sf_dir, "events"), F.col("n_nationkey")
    matches = e.select("event_id", (F.col("user_id") % 5).alias("project_id"), (F.col("user_id") % 20).alias("alert_id"))
    subscriptions = table(spark, sf_dir, "nation").select(n.alias("subscription_id"), (n % 5).cast("long").alias("project_id"), F.when(n % 3 != 0, n % 20).cast("long").alias("alert_id"), (n % 7 != 0).alias("enabled"), F.lit("alert").alias("kind"))
    delivered = e.select("event_id", (F.col("event_id") % 11).alias("slot")).join(subscriptions.select("subscription_id", (F.col("subscription_id") % 11).cast("long").alias("slot")), "slot").select("subscription_id", "event_id")
    return fan_out(matches, subscriptions, delivered)
