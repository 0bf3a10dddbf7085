"""Point lookups, artifacts by their own level, audit, sweeps by policy, members in scope, stale ancestors."""

from pyspark.sql import functions as F

from memlake.operators.access import LEVELS
from memlake.operators.containers import effective_expiry
from memlake.operators.reading import audit_trail, in_scope_of, looked_up, readable_artifacts, stale_ancestors, strictest_owner, sweep
from memlake.plans.container_queries import _EXPIRY_SQL, _LINKS_SQL, _NOW, _links
from memlake.plans.lens import ITEMS_SQL, READER, items, members
from memlake.plans.registry import query, table

#: An artifact for every two records, with a level and an owner of its own.
_ARTIFACTS_SQL = f"""{ITEMS_SQL}, arts AS (SELECT DISTINCT doc_id // 2 AS artifact_id, 'u' || (doc_id // 2 % 5) AS owner_id, ['private','restricted','shared','org','public'][(doc_id // 2 % 5 + 1)::INT] AS access_level,
  ['user:u' || (doc_id // 2 % 4)] AS shared_with, doc_id // 2 % 13 = 0 AS deleted FROM documents),
read AS (SELECT artifact_id FROM arts WHERE NOT deleted AND (access_level IN ('org','public') OR (access_level IN ('private','shared') AND owner_id = 'u1') OR (access_level IN ('shared','restricted') AND list_has_any(shared_with, ['user:u1','group:g0']))))"""


def _artifacts(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select(F.expr("doc_id div 2").alias("artifact_id")).distinct()
    n = F.col("artifact_id")
    return a.select(n, F.lit("en").alias("org_id"), F.concat(F.lit("u"), n % 5).alias("owner_id"), F.get(F.array(*[F.lit(x) for x in LEVELS]), (n % 5).cast("int")).alias("access_level"), F.array(F.concat(F.lit("user:u"), n % 4)).alias("shared_with"), (n % 13 == 0).alias("deleted"))


def _sources(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.expr("doc_id div 2").alias("artifact_id"), F.col("doc_id").alias("data_id"))


@query(f"WITH {_ARTIFACTS_SQL} SELECT artifact_id, doc_id AS data_id FROM documents JOIN read ON artifact_id = doc_id // 2")
def artifact_reads(spark, sf_dir):
    """What may be read of each record's derived layer, by the artifact's level and not the record's."""
    return readable_artifacts(_artifacts(spark, sf_dir), _sources(spark, sf_dir), READER).select("artifact_id", "data_id")


@query(f"""WITH {_ARTIFACTS_SQL}, held AS (SELECT conv_id % 7 * 1000 + turn AS data_id, count(DISTINCT conv_id) AS memories FROM conversations GROUP BY 1)
SELECT s.data_id, project_id, access_level, event_time, (s.data_id // 2 IN (SELECT artifact_id FROM read))::BIGINT AS artifacts, coalesce(memories, 0) AS memories FROM seen s LEFT JOIN held USING (data_id)""")
def point_lookup(spark, sf_dir):
    """Every record asked for: those that the reader sees have a row with counts of what the reader sees."""
    asked = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("data_id"))
    return looked_up(items(spark, sf_dir), asked, _artifacts(spark, sf_dir), _sources(spark, sf_dir), members(spark, sf_dir), READER)


_TRAIL = "event_id AS id, event_type AS action, event_id % 97 AS subject, 'u' || user_id AS actor, ts AS at"


@query(f"""SELECT * FROM (SELECT 'writes' AS store, {_TRAIL} FROM events WHERE event_type IN ('signup', 'purchase') AND user_id % 2 = 0 ORDER BY ts DESC, event_id LIMIT 100)
UNION ALL SELECT * FROM (SELECT 'reads', {_TRAIL} FROM events WHERE event_type IN ('view', 'click') AND user_id % 2 = 0 ORDER BY ts DESC, event_id LIMIT 100)""")
def audit(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    log = e.select(F.col("event_id").alias("id"), F.when(F.col("user_id") % 2 == 0, "en").otherwise("fr").alias("org_id"), F.lit("p").alias("project_id"), F.col("event_type").alias("action"), (F.col("event_id") % 97).alias("subject"), F.concat(F.lit("u"), "user_id").alias("actor"), F.col("ts").alias("at"))
    return audit_trail(log.where(F.col("action").isin("signup", "purchase")), log.where(F.col("action").isin("view", "click")), "en", "p")


@query(f"""WITH {_EXPIRY_SQL}, d AS (SELECT data_id, binding, substr(binding, 2)::BIGINT AS n FROM eff WHERE expires_at < TIMESTAMP '{_NOW}')
SELECT data_id, binding, CASE n % 4 WHEN 0 THEN CASE WHEN data_id % 5 = 0 THEN 'held' ELSE 'deleted' END WHEN 1 THEN 'archived' WHEN 2 THEN 'refiled' ELSE 'kept' END AS outcome FROM d""")
def policy_sweep(spark, sf_dir):
    """What becomes of every record whose time is up, by the policy of the memory that binds it; legal holds are spared."""
    m = members(spark, sf_dir)
    policy = F.get(F.array(F.lit("orphan_delete"), F.lit("archive"), F.lit("keep_members"), F.lit(None)), (F.substring("memory_id", 2, 18).cast("long") % 4).cast("int"))
    due = effective_expiry(m).where(F.col("expires_at") < F.lit(_NOW).cast("timestamp_ntz"))
    return sweep(due, m.select("memory_id").distinct().withColumn("on_expiry", policy), m.where("data_id % 5 = 0").select("data_id"))


_SCOPE_SQL = f"""{_LINKS_SQL}, {ITEMS_SQL}, inside(id, depth) AS (SELECT 'r1', 0 UNION SELECT child, depth + 1 FROM inside JOIN links ON parent = id WHERE depth < 12),
held AS (SELECT data_id, min(depth)::INT AS depth FROM (SELECT 's' || (doc_id % (SELECT count(*) FROM supplier)) AS memory_id, doc_id AS data_id FROM documents UNION ALL SELECT 'n' || (doc_id % 25), doc_id FROM documents WHERE doc_id % 2 = 0) m JOIN inside ON id = memory_id GROUP BY 1),
scope AS (SELECT s.data_id, depth, s.access_level, s.owner_id FROM seen s JOIN held USING (data_id) WHERE s.data_id % 3 <> 0)"""


def _scope(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("data_id"))
    n = table(spark, sf_dir, "supplier").count()
    held = d.select(F.concat(F.lit("s"), F.col("data_id") % n).alias("memory_id"), "data_id").union(d.where("data_id % 2 = 0").select(F.concat(F.lit("n"), F.col("data_id") % 25), "data_id"))
    return in_scope_of(_links(spark, sf_dir), held, items(spark, sf_dir), "r1", READER, F.col("data_id") % 3 == 0)


@query(f"WITH RECURSIVE {_SCOPE_SQL} SELECT data_id, depth FROM scope")
def members_in_scope(spark, sf_dir):
    return _scope(spark, sf_dir)


@query(f"""WITH RECURSIVE {_SCOPE_SQL} SELECT access_level, owner_id FROM scope
  ORDER BY list_position(['private','restricted','shared','org','public'], access_level), data_id LIMIT 1""")
def scope_owner(spark, sf_dir):
    """Whose an artifact over a scope is."""
    return strictest_owner(_scope(spark, sf_dir), items(spark, sf_dir))


@query("""WITH RECURSIVE d AS (SELECT c_custkey AS child, c_custkey // 3 AS parent FROM customer WHERE c_custkey // 3 <> c_custkey UNION SELECT c_custkey, c_custkey // 2 FROM customer WHERE c_custkey % 5 = 0 AND c_custkey // 2 <> c_custkey),
w(root, id, depth) AS (SELECT c_custkey, c_custkey, 0 FROM customer WHERE c_custkey % 50 = 7 UNION SELECT root, child, depth + 1 FROM w JOIN d ON parent = id WHERE depth < 64)
SELECT id, min(depth)::INT AS steps FROM w WHERE depth > 0 GROUP BY 1""")
def stale_derived(spark, sf_dir):
    """Memories derived, at any depth, from those that changed."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    derived = c.select(F.col("k").alias("child"), F.expr("k div 3").alias("parent")).union(c.where("k % 5 = 0").select("k", F.expr("k div 2"))).where("child <> parent")
    return stale_ancestors(derived, c.where("k % 50 = 7").select(F.col("k").alias("root")))
