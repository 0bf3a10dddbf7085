"""Links by provenance, selections to process again, health and listings."""

from pyspark.sql import functions as F

from memlake.operators.upkeep import RELATIONS, Again, linked, platform_health, to_reprocess, watch_list
from memlake.plans.lens import ITEMS_SQL, READER, items
from memlake.plans.registry import query, table

#: Half of the customers have links that stand; as many are asked for, some wrong, some backwards, some twice.
_LINKS_SQL = f"""rel AS (SELECT {list(RELATIONS)} AS r), n AS (SELECT count(*) AS n FROM customer),
standing AS (SELECT 'm' || c_custkey AS source, r[c_custkey % 5 + 1] AS relation, 'm' || (c_custkey // 2) AS target, CASE WHEN c_custkey % 3 = 0 THEN 'explicit' ELSE 'agent' END AS created_by, CASE WHEN c_custkey % 3 <> 0 THEN 0.5::DOUBLE END AS confidence FROM customer, rel WHERE c_custkey % 2 = 0 AND c_custkey > 1),
asked AS (SELECT c_custkey AS seq, CASE WHEN c_custkey % 11 = 3 THEN 'm' || (c_custkey // 2) ELSE 'm' || c_custkey END AS source, CASE WHEN c_custkey % 13 = 0 THEN 'likes' WHEN c_custkey % 11 = 3 THEN r[c_custkey % 5 + 1] ELSE r[c_custkey % 5 + 1] END AS relation,
  CASE WHEN c_custkey % 11 = 3 THEN 'm' || c_custkey WHEN c_custkey % 17 = 0 THEN 'm' || c_custkey WHEN c_custkey % 19 = 0 THEN 'gone' ELSE 'm' || (c_custkey // 2) END AS target,
  CASE WHEN c_custkey % 4 = 0 THEN 'explicit' WHEN c_custkey % 4 = 1 THEN 'routed' ELSE 'agent' END AS created_by, CASE WHEN c_custkey % 4 <> 0 OR c_custkey % 23 = 0 THEN 0.9::DOUBLE END AS confidence FROM customer, rel WHERE c_custkey > 1),
known AS (SELECT 'm' || c_custkey AS id FROM customer),
judged AS (SELECT *, CASE WHEN relation = 'likes' THEN 'unknown_relation' WHEN source = target THEN 'linked_to_itself' WHEN created_by = 'explicit' AND confidence IS NOT NULL THEN 'statement_with_confidence'
  WHEN source NOT IN (SELECT id FROM known) OR target NOT IN (SELECT id FROM known) THEN 'no_such_memory' END AS error FROM asked),
ways AS (SELECT relation, source, target FROM standing UNION SELECT relation, source, target FROM judged WHERE error IS NULL),
go(relation, root, id) AS (SELECT relation, target, target FROM judged WHERE error IS NULL UNION SELECT g.relation, root, w.target FROM go g JOIN ways w ON w.relation = g.relation AND w.source = g.id),
final AS (SELECT j.*, coalesce(error, CASE WHEN EXISTS (SELECT 1 FROM go WHERE go.relation = j.relation AND root = j.target AND go.id = j.source) THEN 'closes_a_circle' END) AS told FROM judged j)"""


def _linked(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    m = lambda x: F.concat(F.lit("m"), x)
    k, half = F.col("k"), F.expr("k div 2")
    relation = F.get(F.array(*[F.lit(r) for r in RELATIONS]), (k % 5).cast("int"))
    standing = c.where("k % 2 = 0 and k > 1").select(m(k).alias("source"), relation.alias("relation"), m(half).alias("target"), F.when(k % 3 == 0, "explicit").otherwise("agent").alias("created_by"), F.when(k % 3 != 0, F.lit(0.5).cast("double")).alias("confidence"))
    asked = c.where("k > 1").select(
        k.alias("seq"), F.when(k % 11 == 3, m(half)).otherwise(m(k)).alias("source"), F.when(k % 13 == 0, "likes").otherwise(relation).alias("relation"),
        F.when(k % 11 == 3, m(k)).when(k % 17 == 0, m(k)).when(k % 19 == 0, "gone").otherwise(m(half)).alias("target"),
        F.when(k % 4 == 0, "explicit").when(k % 4 == 1, "routed").otherwise("agent").alias("created_by"), F.when((k % 4 != 0) | (k % 23 == 0), F.lit(0.9).cast("double")).alias("confidence"))
    return linked(standing, asked, c.select(m(k).alias("memory_id")))


@query(f"""WITH RECURSIVE {_LINKS_SQL}, every AS (SELECT source, relation, target, created_by, confidence, -1 AS seq FROM standing UNION ALL SELECT source, relation, target, created_by, confidence, seq FROM final WHERE told IS NULL)
SELECT source, relation, target, CASE WHEN bool_or(created_by = 'explicit') THEN 'explicit' ELSE arg_max(created_by, seq) END AS created_by, CASE WHEN NOT bool_or(created_by = 'explicit') THEN arg_max(confidence, seq) END AS confidence FROM every GROUP BY 1, 2, 3""")
def memory_links(spark, sf_dir):
    return _linked(spark, sf_dir)[0]


@query(f"WITH RECURSIVE {_LINKS_SQL} SELECT seq, told AS error FROM final WHERE told IS NOT NULL")
def links_refused(spark, sf_dir):
    return _linked(spark, sf_dir)[1]


@query(f"""WITH {ITEMS_SQL} SELECT s.data_id FROM seen s WHERE s.text IS NOT NULL AND s.data_id % 4 <> 0 AND s.data_id % 5 IN (1, 2, 3)
  AND s.data_id IN (SELECT doc_id FROM labels WHERE quality = 0) AND s.data_id IN (SELECT doc_id FROM labels WHERE doc_id % 3 <> 0)""")
def reprocess_selection(spark, sf_dir):
    """Mail with some tags whose artifact another generator made and which is marked stale."""
    i = items(spark, sf_dir).withColumn("data_type", F.when(F.col("data_id") % 4 == 0, "note").otherwise("mail")).withColumn("run_id", F.lit("r")).withColumn("tags", F.array(F.concat(F.lit("t"), F.col("data_id") % 5)))
    labels = table(spark, sf_dir, "labels")
    artifacts = labels.select(F.col("doc_id").alias("artifact_id"), F.when(F.col("quality") == 0, "old").otherwise("now").alias("generator_version"), F.when(F.col("doc_id") % 3 != 0, "source_deleted").alias("stale_reason"))
    sources = labels.select(F.col("doc_id").alias("artifact_id"), F.col("doc_id").alias("data_id"))
    return to_reprocess(i, artifacts, sources, Again(data_type="mail", tags=("t1", "t2", "t3"), stale_generator="now", stale_only=True), READER).select("data_id")


@query("""WITH r AS (SELECT lang AS org_id, source AS project_id, CASE WHEN n_chars < 500 THEN 'stored' ELSE 'searchable' END AS state, CASE WHEN doc_id % 29 = 0 THEN 'failed' WHEN doc_id % 31 = 0 THEN 'partial' WHEN doc_id % 7 <> 0 THEN 'parsed' END AS parse_status,
  CASE WHEN doc_id % 17 = 0 THEN TIMESTAMP '2024-02-01' + to_hours((doc_id % 48)::INT) END AS deleted_at, doc_id % 34 = 0 AS purged FROM documents), l AS (SELECT * FROM r WHERE deleted_at IS NULL)
SELECT 'items_by_state' AS measure, state AS key, count(*) AS n FROM l GROUP BY 2 UNION ALL SELECT 'parse_problems', parse_status, count(*) FROM l WHERE parse_status <> 'parsed' GROUP BY 2
UNION ALL SELECT 'items', NULL, count(*) FROM l UNION ALL SELECT 'unpurged_tombstones', NULL, count(*) FROM r WHERE deleted_at < TIMESTAMP '2024-02-02 11:00:00' AND NOT purged
UNION ALL SELECT 'live_shares', NULL, count(*) FROM pages WHERE page_id % 5 <> 0 AND page_id % 48 > 36 UNION ALL SELECT 'orgs', NULL, count(DISTINCT org_id) FROM r UNION ALL SELECT 'projects', NULL, count(*) FROM (SELECT DISTINCT org_id, project_id FROM r)""")
def health(spark, sf_dir):
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    hours = lambda start, h: F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), h.cast("int"))
    deleted = F.when(k % 17 == 0, hours("2024-02-01", k % 48))
    records = d.select(F.col("lang").alias("org_id"), F.col("source").alias("project_id"), F.when(F.col("n_chars") < 500, "stored").otherwise("searchable").alias("state"), F.when(k % 29 == 0, "failed").when(k % 31 == 0, "partial").when(k % 7 != 0, "parsed").alias("parse_status"), deleted.alias("deleted_at"), F.when(k % 34 == 0, deleted).alias("purged_at"))
    p = F.col("page_id")
    shares = table(spark, sf_dir, "pages").select(hours("2024-02-01", p % 48).alias("expires_at"), F.when(p % 5 == 0, hours("2024-02-01", p % 3)).alias("revoked_at"))
    return platform_health(records, shares, F.lit("2024-02-02 12:00:00").cast("timestamp_ntz"))


@query("""SELECT w.user_id AS watch, count(*) FILTER (event_type = 'error') AS matches, max(ts) FILTER (event_type = 'error') AS last_match, max(ts) FILTER (event_type IN ('view', 'error')) AS last_run
  FROM (SELECT DISTINCT user_id FROM events) w LEFT JOIN events e ON e.user_id = w.user_id GROUP BY 1""")
def watches_listed(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("watch"), F.col("ts").alias("at"), "event_type")
    return watch_list(e.select("watch").distinct(), e.where("event_type = 'error'"), e.where(F.col("event_type").isin("view", "error")))
