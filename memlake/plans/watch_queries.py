"""Alerts and standing queries with a kept watermark."""

from pyspark.sql import functions as F

from memlake.operators.access import visible
from memlake.operators.written import new_path, written
from memlake.plans.lens import ITEMS_SQL, READER, items
from memlake.plans.registry import query, table
from memlake.streaming.watches import Watch, Watching, World

#: An event tells of a record (two of three) or of a fact, whose evidence is two records; records are in memories of 11 parts and in cases.
_WORLD_SQL = f"""{ITEMS_SQL}, n AS (SELECT count(*) AS n FROM documents),
ev AS (SELECT event_id AS sequence, event_type AS surface, value, user_id, CASE WHEN event_id % 3 < 2 THEN event_id % n END AS data_id, CASE WHEN event_id % 3 = 2 THEN event_id // 3 END AS fact_id FROM events, n),
behind AS (SELECT sequence, data_id FROM ev WHERE data_id IS NOT NULL UNION ALL SELECT sequence, unnest([fact_id % n, (fact_id * 7) % n]) FROM ev, n WHERE fact_id IS NOT NULL),
rec AS (SELECT data_id, text, CASE WHEN data_id % 4 = 0 THEN 'note' ELSE 'mail' END AS data_type, data_id IN (SELECT data_id FROM seen) AS visible, deleted FROM items)"""
_PICKED_SQL = """hit AS (
  SELECT 'large' AS watch, sequence, data_id FROM ev WHERE surface = 'purchase' AND value > 60
  UNION ALL SELECT 'in_memory', sequence, data_id FROM ev WHERE surface = 'click' AND value > 10 AND sequence IN (SELECT sequence FROM behind WHERE data_id % 11 IN (2, 3, 4))
  UNION ALL SELECT 'in_both', sequence, data_id FROM ev WHERE surface = 'view' AND sequence IN (SELECT sequence FROM behind WHERE data_id % 11 = 5) AND sequence IN (SELECT sequence FROM behind WHERE data_id % 4 = 1)
  UNION ALL SELECT 'of_entity', sequence, data_id FROM ev WHERE surface = 'error' AND user_id = 7
  UNION ALL SELECT 'brand', sequence, ev.data_id FROM ev JOIN rec USING (data_id) WHERE surface = 'signup' AND data_type = 'mail'
    AND regexp_matches(' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' ') || ' ', ' (licens(e|es|ed|ing|e.s)|toxics?|worthless(ness|ly)?) '))"""


def _watches(cap):
    return [
        Watch("large", "purchase", cap, {"value": {"op": "gt", "value": 60}}),
        Watch("in_memory", "click", cap, {"value": {"op": "gt", "value": 10}}, memory="m2"),
        Watch("in_both", "view", cap, memory="m5", case="c1"),
        Watch("of_entity", "error", cap, entity="e7"),
        Watch("brand", "signup", cap, question='"license" or toxic or worthless', data_type="mail"),
    ]


def _world(spark, sf_dir):
    e, d = table(spark, sf_dir, "events"), table(spark, sf_dir, "documents")
    n = d.count()
    tells = F.col("event_id") % 3 < 2
    fact = F.when(~tells, F.expr("event_id div 3"))
    payload = F.to_json(F.struct("value", F.concat(F.lit("e"), "user_id").alias("subject_id")))
    events = e.select(F.col("event_id").alias("sequence"), F.col("event_type").alias("surface"), payload.alias("payload"), F.when(tells, F.col("event_id") % n).alias("data_id"), fact.alias("fact_id"))
    evidence = events.where("fact_id is not null").select("fact_id", F.explode(F.array(F.col("fact_id") % n, F.col("fact_id") * 7 % n)).alias("data_id"))
    i = items(spark, sf_dir)
    records = i.select("data_id", F.when(F.col("data_id") % 4 == 0, "note").otherwise("mail").alias("data_type"), F.array(F.concat(F.lit("t"), F.col("data_id") % 5)).alias("tags"), "text", visible(READER).alias("visible"))
    held = lambda kind, prefix, m: i.select(F.lit(kind).alias("kind"), F.concat(F.lit(prefix), F.col("data_id") % m).alias("container"), "data_id")
    contained = spark.createDataFrame([(f"m{a}", f"m{b}") for a in range(11) for b in ({a, 3, 4} if a == 2 else {a})], "memory string, part string")
    return World(events, records, evidence, held("memory", "m", 11).unionByName(held("case", "c", 4)), contained)


def _followed(spark, sf_dir):
    """Runs until nothing is deferred, each over a third of the longest surface at most."""
    world, watching = _world(spark, sf_dir), Watching(spark, new_path(spark, "watches"))
    longest = world.events.groupBy("surface").count().agg(F.max("count")).first()[0] or 0
    reports = []
    for n in range(5):
        report = written(watching.run(_watches(longest // 3 + 1), world))
        reports.append(report.withColumn("run", F.lit(n)))
        if report.where("deferred > 0").isEmpty():
            break
    return watching, reports


@query(f"WITH {_WORLD_SQL}, {_PICKED_SQL} SELECT watch, sequence, data_id, coalesce(visible, false) AS visible FROM hit LEFT JOIN rec USING (data_id)")
def watch_matches(spark, sf_dir):
    """What several runs with a cap have recorded: all that one run without a cap would."""
    return _followed(spark, sf_dir)[0].matches()


@query(f"""WITH {_WORLD_SQL}, {_PICKED_SQL}, w(watch, surface) AS (VALUES ('large', 'purchase'), ('in_memory', 'click'), ('in_both', 'view'), ('of_entity', 'error'), ('brand', 'signup')),
cap AS (SELECT max(c) // 3 + 1 AS cap FROM (SELECT count(*) AS c FROM ev GROUP BY surface)),
placed AS (SELECT watch, sequence, (row_number() OVER (PARTITION BY watch ORDER BY sequence) - 1) // cap AS run, count(*) OVER (PARTITION BY watch) AS total, cap FROM ev JOIN w USING (surface), cap),
g AS (SELECT watch, run, count(*) AS candidates, max(sequence) AS window_to, any_value(total) - (run + 1) * any_value(cap) AS rest FROM placed GROUP BY watch, run)
SELECT g.watch, run::INT AS run, coalesce(lag(window_to) OVER (PARTITION BY g.watch ORDER BY run), -1) AS window_from, window_to, candidates, greatest(rest, 0)::BIGINT AS deferred,
  (SELECT count(*) FROM hit JOIN placed p USING (watch, sequence) WHERE hit.watch = g.watch AND p.run = g.run) AS matches,
  (SELECT min(sequence) FROM hit JOIN placed p USING (watch, sequence) WHERE hit.watch = g.watch AND p.run = g.run) AS first_sample FROM g""")
def watch_runs(spark, sf_dir):
    """The report of each run: its window, candidates, matches and what the cap deferred."""
    reports = _followed(spark, sf_dir)[1]
    rows = reports[0]
    for r in reports[1:]:
        rows = rows.unionByName(r)
    return rows.where("candidates > 0").select("watch", "run", "window_from", "window_to", "candidates", "deferred", "matches", F.get("samples", F.lit(0)).alias("first_sample"))
