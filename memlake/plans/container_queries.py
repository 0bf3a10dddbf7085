"""Memories, cases, compaction and lifecycle."""

from pyspark.sql import functions as F

from memlake.operators.access import visible
from memlake.operators.containers import closure, duplicates, effective_expiry, expiry, purged, remaining, route_cases, summaries, summary_spans, would_cycle
from memlake.operators.running import running
from memlake.plans.lens import ITEMS_SQL, MEMBERS_SQL, READER, items, members
from memlake.plans.registry import query, table

_NOW = "2024-01-03 06:00:00"
_LINKS_SQL = "links AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'r' || r_regionkey, 'w' FROM region UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"
_EXPIRY_SQL = f"{MEMBERS_SQL}, e AS (SELECT *, added_at + to_seconds(ttl) AS ends FROM members), x AS (SELECT data_id, count_if(ends IS NULL) AS unbounded, max(ends) AS latest FROM e GROUP BY 1), eff AS (SELECT x.data_id, CASE WHEN unbounded = 0 THEN latest END AS expires_at, CASE WHEN unbounded = 0 THEN (SELECT 'm' || min(substr(memory_id, 2)::BIGINT) FROM e WHERE e.data_id = x.data_id AND ends = latest) END AS binding FROM x)"


def _links(spark, sf_dir):
    pair = lambda t, p, k, q, v: table(spark, sf_dir, t).select(F.concat(F.lit(p), k).alias("child"), F.concat(F.lit(q), v).alias("parent"))
    world = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("child"), F.lit("w").alias("parent"))
    return pair("nation", "n", "n_nationkey", "r", "n_regionkey").union(world).union(pair("supplier", "s", "s_suppkey", "n", "s_nationkey"))


@query(f"WITH {_EXPIRY_SQL} SELECT * FROM eff")
def effective_expiries(spark, sf_dir):
    return effective_expiry(members(spark, sf_dir))


@query(f"WITH {_EXPIRY_SQL} SELECT * FROM eff WHERE expires_at < TIMESTAMP '{_NOW}'")
def due_for_expiry(spark, sf_dir):
    return effective_expiry(members(spark, sf_dir)).where(F.col("expires_at") < F.lit(_NOW).cast("timestamp_ntz"))


@query(f"WITH {MEMBERS_SQL} SELECT memory_id, count(DISTINCT data_id) AS members, count_if(role = 'user') AS asked, max(added_at + to_seconds(ttl)) AS last_expiry FROM members GROUP BY 1")
def memory_context(spark, sf_dir):
    return members(spark, sf_dir).groupBy("memory_id").agg(F.countDistinct("data_id").alias("members"), F.count_if(F.col("role") == "user").alias("asked"), F.max(expiry()).alias("last_expiry"))


@query(f"""WITH {MEMBERS_SQL} SELECT DISTINCT m.memory_id, m.data_id FROM members m
  WHERE NOT EXISTS (SELECT 1 FROM members o WHERE o.data_id = m.data_id AND o.memory_id <> m.memory_id)""")
def sole_held(spark, sf_dir):
    """Records that one memory alone holds."""
    held = members(spark, sf_dir).groupBy("data_id").agg(F.min("memory_id").alias("memory_id"), F.max("memory_id").alias("other"))
    return held.where("memory_id = other").select("memory_id", "data_id")


@query(f"""WITH RECURSIVE {_LINKS_SQL}, c(root, id, depth) AS (SELECT 'w', 'w', 0 UNION SELECT root, child, depth + 1 FROM c JOIN links ON parent = id WHERE depth < 12)
SELECT root, id, min(depth)::INT AS depth FROM c GROUP BY 1, 2""")
def memory_closure(spark, sf_dir):
    return closure(_links(spark, sf_dir), spark.createDataFrame([("w",)], "root string"))


@query(f"""WITH RECURSIVE {_LINKS_SQL}, c(id, depth) AS (SELECT 's1', 0 UNION SELECT parent, depth + 1 FROM c JOIN links ON child = id WHERE depth < 12)
SELECT c.id, min(depth)::INT AS depth, (SELECT count(*) FROM links WHERE parent = c.id) AS children FROM c GROUP BY 1""")
def memory_tree(spark, sf_dir):
    links = _links(spark, sf_dir)
    up = closure(links.select(F.col("parent").alias("child"), F.col("child").alias("parent")), spark.createDataFrame([("s1",)], "root string"))
    children = links.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("children"))
    return up.join(children, "id", "left").select("id", "depth", F.coalesce("children", F.lit(0)).alias("children"))


@query(f"""WITH RECURSIVE {_LINKS_SQL}, p AS (SELECT * FROM (VALUES ('r1', 'n1'), ('n1', 'r2'), ('w', 's1'), ('w', 'w'), ('s1', 's2')) v(child, parent)),
c(root, id, depth) AS (SELECT child, child, 0 FROM p UNION SELECT root, l.child, depth + 1 FROM c JOIN links l ON l.parent = id WHERE depth < 64)
SELECT child, parent, EXISTS (SELECT 1 FROM c WHERE root = p.child AND id = p.parent) AS refused FROM p""")
def cycle_check(spark, sf_dir):
    proposed = spark.createDataFrame([("r1", "n1"), ("n1", "r2"), ("w", "s1"), ("w", "w"), ("s1", "s2")], "child string, parent string")
    return would_cycle(_links(spark, sf_dir), proposed)


@query("""WITH k AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE length(text) || ':' || left(text, 200) END AS key, length(text) AS n, doc_id % 2 AS form FROM documents)
SELECT doc_id AS data_id, doc_id = max(doc_id) OVER (PARTITION BY form, key) AS kept, CASE WHEN doc_id = max(doc_id) OVER (PARTITION BY form, key) THEN 0 ELSE n END::BIGINT AS bytes_freed FROM k""")
def dedupe_exact(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return duplicates(d.select(F.col("doc_id").alias("data_id"), F.when(F.col("doc_id") % 2 == 0, F.sha2("text", 256)).alias("checksum"), "text"))


@query(f"""WITH {ITEMS_SQL} SELECT project_id, data_id, coalesce(sum(length(text) + 2) OVER w, 0)::BIGINT AS span_start, (coalesce(sum(length(text) + 2) OVER w, 0) + length(text))::BIGINT AS span_end
  FROM seen WINDOW w AS (PARTITION BY project_id ORDER BY data_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def summary_span(spark, sf_dir):
    return summary_spans(items(spark, sf_dir).where(visible(READER)), "project_id")


@query(f"""WITH {ITEMS_SQL}, b AS (SELECT project_id, data_id, trim(text, ' ') AS t, access_level, row_number() OVER (PARTITION BY project_id ORDER BY data_id) AS n FROM items WHERE NOT deleted QUALIFY n <= 20)
SELECT project_id, md5(string_agg(t, chr(10) || chr(10) ORDER BY data_id)) AS content, ['private','restricted','shared','org','public'][min(list_position(['private','restricted','shared','org','public'], access_level))::INT] AS level,
  count(*) AS sources, (sum(length(t) + 2) - 2)::BIGINT AS last_end FROM b GROUP BY 1 HAVING count(*) > 1""")
def summary_artifacts(spark, sf_dir):
    """One artifact for the first twenty records of each project, as strict as its strictest source."""
    made = summaries(items(spark, sf_dir).where(~F.col("deleted")), "project_id", 20)
    return made.select("project_id", F.md5("text").alias("content"), "level", F.size("sources").cast("long").alias("sources"), F.element_at("sources", -1)["span_end"].alias("last_end"))


_CASES_SQL = """r AS (SELECT o_orderkey AS data_id, 'c' || o_custkey AS external_id, ['p' || o_orderpriority, 'd' || o_orderkey] AS ids FROM orders),
k AS (SELECT c_custkey AS case_id, 'c' || c_custkey AS case_key, ['d' || (c_custkey * 7), 'x' || c_nationkey] AS ids FROM customer),
b AS (SELECT data_id, case_id, max(f) AS confidence FROM (SELECT data_id, case_id, 1.0 AS f FROM r JOIN k ON external_id = case_key
  UNION ALL SELECT data_id, case_id, 0.8 FROM (SELECT data_id, unnest(ids) AS i FROM r) JOIN (SELECT case_id, unnest(ids) AS i FROM k) USING (i)) GROUP BY 1, 2)"""


def _cases(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    r = o.select(F.col("o_orderkey").alias("data_id"), F.concat(F.lit("c"), "o_custkey").alias("external_id"), F.array(F.concat(F.lit("p"), "o_orderpriority"), F.concat(F.lit("d"), "o_orderkey")).alias("identifiers"))
    k = c.select(F.col("c_custkey").alias("case_id"), F.concat(F.lit("c"), "c_custkey").alias("case_key"), F.array(F.concat(F.lit("d"), F.col("c_custkey") * 7), F.concat(F.lit("x"), "c_nationkey")).alias("identifiers"))
    return route_cases(r, k)


@query(f"WITH {_CASES_SQL} SELECT data_id, case_id, confidence::DOUBLE AS confidence, CASE WHEN confidence = 1 THEN 'asserted' ELSE 'inferred' END AS basis FROM b")
def case_routing(spark, sf_dir):
    return _cases(spark, sf_dir)


@query(f"WITH {_CASES_SQL} SELECT case_id, count(*) AS records, count_if(confidence = 1) AS asserted, count_if(confidence < 1) AS inferred, min(o_orderdate) AS first_event, max(o_orderdate) AS last_event FROM b JOIN orders ON data_id = o_orderkey GROUP BY 1")
def case_timeline(spark, sf_dir):
    rows = _cases(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("data_id"), "o_orderdate"), "data_id")
    return rows.groupBy("case_id").agg(F.count("*").alias("records"), F.count_if(F.col("basis") == "asserted").alias("asserted"), F.count_if(F.col("basis") == "inferred").alias("inferred"), F.min("o_orderdate").alias("first_event"), F.max("o_orderdate").alias("last_event"))


@query(f"""WITH {ITEMS_SQL}, gone AS (SELECT data_id FROM items WHERE project_id = 'src3' AND data_id % 11 <> 0)
SELECT 'labels' AS tab, count_if(doc_id IN (SELECT data_id FROM gone)) AS removed, count_if(doc_id NOT IN (SELECT data_id FROM gone)) AS left_over FROM labels
UNION ALL SELECT 'embeddings', count_if(vec_id IN (SELECT data_id FROM gone)), count_if(vec_id NOT IN (SELECT data_id FROM gone)) FROM embeddings
UNION ALL SELECT 'items', count_if(data_id IN (SELECT data_id FROM gone)), count_if(data_id NOT IN (SELECT data_id FROM gone)) FROM items""")
def purge_cascade(spark, sf_dir):
    """What an erasure of one project (legal holds left out) removes from each dependent table, by one left join each."""
    rows = items(spark, sf_dir)
    gone = rows.where((F.col("project_id") == "src3") & (F.col("data_id") % 11 != 0)).select("data_id", F.lit(True).alias("gone")).distinct()
    parts = [("labels", table(spark, sf_dir, "labels").select(F.col("doc_id").alias("data_id"))), ("embeddings", table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("data_id"))), ("items", rows.select("data_id"))]
    counted = [t.join(gone, "data_id", "left").agg(F.count("gone").alias("removed"), F.count_if(F.col("gone").isNull()).alias("left_over")).select(F.lit(n).alias("tab"), "removed", "left_over") for n, t in parts]
    return counted[0].union(counted[1]).union(counted[2])


@query(f"""WITH {ITEMS_SQL}, gone AS (SELECT data_id FROM items WHERE project_id = (SELECT min(project_id) FROM items) AND data_id % 11 <> 0)
SELECT 'labels' AS tab, count(*) AS remaining, count(*) = 0 AS complete FROM labels WHERE doc_id IN (SELECT data_id FROM gone) AND doc_id % 7 = 0
UNION ALL SELECT 'embeddings', count(*), count(*) = 0 FROM embeddings WHERE vec_id IN (SELECT data_id FROM gone) AND vec_id % 3 = 0
UNION ALL SELECT 'items', count(*), count(*) = 0 FROM items WHERE data_id IN (SELECT data_id FROM gone) AND deleted""")
def erasure_proof(spark, sf_dir):
    """What still refers to an erased record after a purge that lost a seventh of the labels' deletions and a third of the
    embeddings' and skipped records already marked as deleted."""
    rows = items(spark, sf_dir)
    project = rows.agg(F.min("project_id").alias("project_id"))
    gone = rows.join(project, "project_id", "left_semi").where("data_id % 11 <> 0").select("data_id").distinct()
    stores = {
        "labels": (table(spark, sf_dir, "labels").select(F.col("doc_id").alias("data_id")), F.col("data_id") % 7 != 0),
        "embeddings": (table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("data_id")), F.col("data_id") % 3 != 0),
        "items": (rows.select("data_id", "deleted"), ~F.col("deleted")),
    }
    after = {name: purged(store, gone, reached).select("data_id") for name, (store, reached) in stores.items()}
    return remaining(after, gone)


@query(f"""WITH {ITEMS_SQL} SELECT data_id, CASE WHEN text = '' THEN 'unparsed' WHEN data_id NOT IN (SELECT vec_id FROM embeddings) THEN 'stored' ELSE 'searchable' END AS sweep
  FROM items WHERE NOT deleted AND data_id NOT IN (SELECT doc_id FROM labels)""")
def reconcile_sweep(spark, sf_dir):
    """What each record needs next, parse before embed before enrich; enriched records need nothing."""
    rows = items(spark, sf_dir).where("not deleted").join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("data_id")), "data_id", "left_anti")
    embedded = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("data_id"), F.lit(True).alias("embedded")).distinct()
    sweep = F.when(F.col("text") == "", "unparsed").when(F.col("embedded").isNull(), "stored").otherwise("searchable")
    return rows.join(embedded, "data_id", "left").select("data_id", sweep.alias("sweep"))


@query("""SELECT doc_id AS data_id, source AS item, row_number() OVER w AS revision, coalesce(md5(text) <> lag(md5(text)) OVER w, false) AS revised
  FROM documents WINDOW w AS (PARTITION BY source, lang ORDER BY doc_id)""")
def version_revisions(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.md5("text").alias("sum"))
    numbered = running(d, ["source", "lang"], ["doc_id"], before={"last": F.col("sum")})
    return numbered.select(F.col("doc_id").alias("data_id"), F.col("source").alias("item"), F.col("n").alias("revision"), F.coalesce(F.col("sum") != F.col("last"), F.lit(False)).alias("revised"))


@query("""SELECT n_nationkey AS scope_id, CASE WHEN r_regionkey = 2 THEN 'locked' ELSE coalesce(CASE WHEN n_nationkey % 2 = 0 THEN 'project' END, CASE WHEN r_regionkey % 2 = 1 THEN 'org' END, 'platform') END AS value
  FROM nation JOIN region ON n_regionkey = r_regionkey""")
def settings_resolve(spark, sf_dir):
    """A locked setting wins from the top, else the narrowest scope that has one."""
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    value = F.when(F.col("r_regionkey") == 2, "locked").otherwise(F.coalesce(F.when(F.col("n_nationkey") % 2 == 0, "project"), F.when(F.col("r_regionkey") % 2 == 1, "org"), F.lit("platform")))
    return n.select(F.col("n_nationkey").alias("scope_id"), value.alias("value"))


@query("""WITH a AS (SELECT * FROM (VALUES ('error', 'm1'), ('*', 'm0'), ('click', 'm2')) v(data_type, model))
SELECT t.event_type AS data_type, coalesce((SELECT model FROM a WHERE a.data_type = t.event_type), (SELECT model FROM a WHERE a.data_type = '*')) AS model FROM (SELECT DISTINCT event_type FROM events) t""")
def model_resolve(spark, sf_dir):
    """An exact data type beats ``*``."""
    a = spark.createDataFrame([("error", "m1"), ("*", "m0"), ("click", "m2")], "data_type string, model string")
    t = table(spark, sf_dir, "events").select(F.col("event_type").alias("t")).distinct()
    exact = t.join(a.select(F.col("data_type").alias("t"), F.col("model").alias("exact")), "t", "left")
    other = a.where("data_type = '*'").select(F.lit(1).alias("any"), F.col("model").alias("other"))
    return exact.withColumn("any", F.lit(1)).join(other, "any", "left").select(F.col("t").alias("data_type"), F.coalesce("exact", "other").alias("model"))
