"""The graph as a reader sees it: lists, details, overview, conflicts and walks over readable evidence, assertion and retraction."""

from pyspark.sql import functions as F

from memlake.operators.evidence import asserted, drawn_under, entity_view, listed_entities, retracted, walk
from memlake.operators.graph import co_mentioned, conflicts
from memlake.plans.fact_queries import _FACTS_SQL, _facts, _held, _live, _named, _seen
from memlake.plans.registry import query, table

_RELATION = "CASE WHEN k % 3 < 2 THEN 'uses' ELSE 'prefers' END"


def _relation(rows):
    return rows.withColumn("predicate", F.when(F.substring("subject", 2, 20).try_cast("long") % 3 < 2, "uses").otherwise("prefers"))


@query(f"WITH {_FACTS_SQL} SELECT id, count(DISTINCT data_id) AS records FROM named GROUP BY 1")
def entities_seen(spark, sf_dir):
    return listed_entities(_named(spark, sf_dir))


@query(f"""WITH {_FACTS_SQL}, mine AS (SELECT DISTINCT data_id FROM named WHERE id = 'p1'),
beside AS (SELECT id, count(DISTINCT data_id) AS n FROM named WHERE id <> 'p1' AND data_id IN (SELECT data_id FROM mine) GROUP BY 1 ORDER BY n DESC, id LIMIT 5)
SELECT 'p1' AS id, (SELECT count(*) FROM mine) AS records, count(*) AS facts, count_if(valid_to IS NULL AND retracted_at IS NULL) AS open_facts,
  (SELECT string_agg(id || '=' || n, ',' ORDER BY n DESC, id) FROM beside) AS beside FROM held WHERE subject = 'p1' OR object = 'p1'""")
def entity_detail(spark, sf_dir):
    return entity_view("p1", _named(spark, sf_dir), _held(spark, sf_dir))


@query(f"WITH {_FACTS_SQL} SELECT id AS entity, count(DISTINCT data_id) AS records FROM named WHERE id <> 'p1' AND data_id IN (SELECT data_id FROM named WHERE id = 'p1') GROUP BY 1")
def comention_seen(spark, sf_dir):
    return co_mentioned(_named(spark, sf_dir).withColumnRenamed("id", "entity"), "p1")


@query(f"WITH {_FACTS_SQL} SELECT subject, {_RELATION} AS predicate, object, evidence FROM live ORDER BY evidence DESC, subject, object LIMIT 200")
def graph_overview_seen(spark, sf_dir):
    """The best backed facts in force, by the evidence that the reader can read."""
    return _relation(_live(spark, sf_dir)).select("subject", "predicate", "object", "evidence").orderBy(F.desc("evidence"), "subject", "object").limit(200)


@query(f"""WITH {_FACTS_SQL} SELECT subject, {_RELATION} AS predicate, count(*) AS claims, string_agg(object, ',' ORDER BY valid_from, object) AS objects FROM held
  WHERE valid_to IS NULL AND retracted_at IS NULL GROUP BY 1, 2 HAVING count(*) > 1""")
def conflicts_seen(spark, sf_dir):
    """Open claims of one relation that contradict each other, as far as the reader sees them."""
    return conflicts(_relation(_held(spark, sf_dir)).where("retracted_at is null"))


@query(f"""WITH RECURSIVE {_FACTS_SQL}, lens AS (SELECT * FROM live WHERE {_RELATION} = 'uses' AND fact_id IN (SELECT fact_id FROM readable WHERE template = 'scripture')),
ways AS (SELECT subject AS a, object AS b FROM lens UNION SELECT object, subject FROM lens),
walk(id, hops) AS (SELECT 'p1', 0 WHERE 'p1' IN (SELECT id FROM named) UNION SELECT b, hops + 1 FROM walk JOIN ways ON a = id WHERE hops < 2)
SELECT id, min(hops)::INT AS hops FROM walk WHERE id IN (SELECT id FROM named) GROUP BY 1""")
def walk_under_template(spark, sf_dir):
    """A walk whose every step is a relation asked for, drawn under the template from evidence that the reader can read."""
    lens = drawn_under(_relation(_live(spark, sf_dir)).where(F.col("predicate").isin("uses")), _seen(spark, sf_dir), "scripture")
    return walk(lens, _named(spark, sf_dir), spark.createDataFrame([("p1",)], "id string"), 2)[0]


_ALL_SQL = f"""{_FACTS_SQL}, every AS (SELECT fact_id, subject, {_RELATION} AS predicate, object, valid_from, valid_to, retracted_at, basis, k FROM facts),
asked AS (SELECT 'n' || c_custkey AS fact_id, CASE WHEN c_custkey % 19 = 0 THEN 'nobody' ELSE 'c' || c_custkey END AS subject, CASE WHEN c_custkey % 17 = 0 THEN 'eats' ELSE 'uses' END AS predicate,
  CASE WHEN c_custkey % 23 = 0 AND c_custkey % 19 <> 0 THEN 'c' || c_custkey ELSE 'p1' END AS object, TIMESTAMP '1992-01-01' AS valid_from FROM customer),
judged AS (SELECT *, CASE WHEN predicate = 'eats' THEN 'unknown_predicate' WHEN subject = object THEN 'related_to_itself' WHEN subject = 'nobody' THEN 'entity_not_found' END AS error FROM asked)"""


def _stated(spark, sf_dir):
    facts = _relation(_facts(spark, sf_dir)).withColumn("confidence", F.lit(0.5)).withColumn("retracted_reason", F.lit(None).cast("string"))
    key = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    claims = c.select(
        F.concat(F.lit("n"), key).alias("fact_id"), F.when(key % 19 == 0, "nobody").otherwise(F.concat(F.lit("c"), key)).alias("subject"), F.when(key % 17 == 0, "eats").otherwise("uses").alias("predicate"),
        F.when((key % 23 == 0) & (key % 19 != 0), F.concat(F.lit("c"), key)).otherwise("p1").alias("object"), F.lit("1992-01-01").cast("timestamp_ntz").alias("valid_from"), F.lit("1998-01-01").cast("timestamp_ntz").alias("recorded_at"),
        F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.lit(None).cast("timestamp_ntz").alias("retracted_at"), F.lit(None).cast("string").alias("retracted_reason"), F.lit("asserted").alias("basis"), F.lit(0.9).cast("double").alias("confidence"),
        F.lit("en").alias("org_id"), F.lit("u1").alias("owner_id"), F.lit("private").alias("access_level"), F.array().cast("array<string>").alias("shared_with"), F.lit(False).alias("deleted"))
    entities = c.select(F.concat(F.lit("c"), key).alias("id")).union(spark.createDataFrame([(f"p{i}",) for i in range(1, 6)], "id string"))
    return asserted(facts, claims, entities, ("uses", "prefers"))


@query(f"""WITH {_ALL_SQL}, good AS (SELECT * FROM judged WHERE error IS NULL), hit AS (SELECT e.fact_id FROM every e JOIN good g USING (subject, predicate, object) WHERE e.valid_to IS NULL AND e.retracted_at IS NULL)
SELECT fact_id, subject, predicate, object, CASE WHEN fact_id IN (SELECT fact_id FROM hit) THEN least(valid_from, TIMESTAMP '1992-01-01') ELSE valid_from END AS valid_from, CASE WHEN fact_id IN (SELECT fact_id FROM hit) THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS confidence, basis,
  CASE WHEN retracted_at IS NOT NULL THEN NULL WHEN k % 13 = 0 THEN 'wrong' END AS retracted_reason, coalesce(retracted_at, CASE WHEN k % 13 = 0 THEN TIMESTAMP '1998-06-01' END) AS retracted_at FROM every
UNION ALL SELECT fact_id, subject, predicate, object, valid_from, 0.9::DOUBLE, 'asserted', CASE WHEN substr(subject, 2)::BIGINT % 13 = 0 THEN 'wrong' END, CASE WHEN substr(subject, 2)::BIGINT % 13 = 0 THEN TIMESTAMP '1998-06-01' END FROM good
  WHERE NOT EXISTS (SELECT 1 FROM every e WHERE e.subject = good.subject AND e.predicate = good.predicate AND e.object = good.object AND e.valid_to IS NULL AND e.retracted_at IS NULL)""")
def facts_stated(spark, sf_dir):
    """All facts after every customer was said to use p1 and those of each thirteenth customer were withdrawn."""
    facts, _ = _stated(spark, sf_dir)
    wrong = facts.where(F.substring("subject", 2, 20).try_cast("long") % 13 == 0).select("fact_id", F.lit("wrong").alias("reason"))
    after = retracted(facts, wrong, F.lit("1998-06-01").cast("timestamp_ntz"))
    return after.select("fact_id", "subject", "predicate", "object", "valid_from", "confidence", "basis", "retracted_reason", "retracted_at")


@query(f"WITH {_ALL_SQL} SELECT fact_id, error FROM judged WHERE error IS NOT NULL")
def assertions_refused(spark, sf_dir):
    return _stated(spark, sf_dir)[1]
