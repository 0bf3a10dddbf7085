"""Access control queries."""

from pyspark.sql import functions as F

from memlake.operators.access import assigned, strictest, visible
from memlake.plans.lens import ITEMS_SQL, READER, items
from memlake.plans.registry import query, table


@query(f"WITH {ITEMS_SQL} SELECT data_id, project_id, access_level FROM seen")
def acl_visible(spark, sf_dir):
    return items(spark, sf_dir).where(visible(READER)).select("data_id", "project_id", "access_level")


@query(f"""WITH {ITEMS_SQL}, g AS (
  SELECT project_id, min(list_position(['private','restricted','shared','org','public'], access_level)) AS r,
    list(DISTINCT list_sort(shared_with)) FILTER (access_level IN ('shared','restricted')) AS l FROM items GROUP BY 1),
h AS (SELECT *, CASE WHEN l IS NULL THEN [] ELSE list_sort(list_reduce(l, lambda a, b: list_intersect(a, b))) END AS p FROM g)
SELECT project_id, ['private','restricted','shared','org','public'][r] AS level, CASE WHEN r IN (2, 3) THEN array_to_string(p, ',') ELSE '' END AS principals FROM h""")
def acl_strictest(spark, sf_dir):
    level, left = strictest()
    return items(spark, sf_dir).groupBy("project_id").agg(level.alias("level"), F.array_join(left, ",").alias("principals"))


@query(f"""WITH {ITEMS_SQL}, w AS (SELECT data_id, CASE WHEN data_id % 4 <> 0 THEN access_level END AS asked, ['shared', 'personal', NULL][(data_id % 3 + 1)::INT] AS scope,
  CASE WHEN data_id % 7 = 0 THEN [] ELSE list_sort(list_distinct(shared_with)) END AS listed FROM items),
l AS (SELECT *, CASE WHEN asked IS NOT NULL THEN asked WHEN scope = 'shared' THEN 'org' ELSE 'private' END AS level FROM w)
SELECT data_id, asked, scope, level, CASE WHEN level IN ('shared', 'restricted') THEN array_to_string(listed, ',') ELSE '' END AS principals,
  CASE WHEN scope = 'personal' AND level <> 'private' THEN 'wider_than_connection' WHEN scope = 'shared' AND level = 'public' THEN 'wider_than_connection'
       WHEN level IN ('shared', 'restricted') AND len(listed) = 0 THEN 'principals_required' END AS error FROM l""")
def acl_for_write(spark, sf_dir):
    scope = F.when(F.col("data_id") % 3 == 0, "shared").when(F.col("data_id") % 3 == 1, "personal")
    listed = F.when(F.col("data_id") % 7 == 0, F.array().cast("array<string>")).otherwise(F.col("shared_with"))
    rows = items(spark, sf_dir).withColumn("asked", F.when(F.col("data_id") % 4 != 0, F.col("access_level"))).withColumn("scope", scope)
    return rows.withColumn("a", assigned(F.col("asked"), listed, F.col("scope"))).select("data_id", "asked", "scope", "a.level", F.array_join("a.principals", ",").alias("principals"), "a.error")


@query(f"WITH {ITEMS_SQL} SELECT data_id, left(text, 80) AS preview, event_time FROM seen WHERE data_id < 500 ORDER BY data_id DESC LIMIT 50")
def list_items_keyset(spark, sf_dir):
    page = items(spark, sf_dir).where(visible(READER) & (F.col("data_id") < 500)).orderBy(F.desc("data_id")).limit(50)
    return page.select("data_id", F.substring("text", 1, 80).alias("preview"), "event_time")


@query(f"""WITH {ITEMS_SQL} SELECT data_id, project_id FROM seen
  WHERE event_time >= TIMESTAMP '2024-01-03' AND event_time <= TIMESTAMP '2024-02-10' AND data_id IN (SELECT doc_id FROM labels WHERE quality = 1)
    AND data_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def retrieval_filters(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    rows = items(spark, sf_dir).where(visible(READER) & F.col("event_time").between(F.lit("2024-01-03").cast("timestamp_ntz"), F.lit("2024-02-10").cast("timestamp_ntz")))
    good = labels.where("quality = 1").select(F.col("doc_id").alias("data_id"))
    bad = labels.where("toxic = 1").select(F.col("doc_id").alias("data_id"))
    return rows.join(good, "data_id", "left_semi").join(bad, "data_id", "left_anti").select("data_id", "project_id")


@query(f"WITH {ITEMS_SQL} SELECT s.data_id, s.org_id FROM seen s WHERE s.org_id <> 'en' OR (s.access_level = 'restricted' AND NOT list_has_any(s.shared_with, ['user:u1','org:en','public','group:g0']))")
def acl_invariant(spark, sf_dir):
    """Must be empty: nothing of another organisation, no restricted row for an owner who is not listed."""
    rows = items(spark, sf_dir).where(visible(READER))
    listed = F.arrays_overlap("shared_with", F.array(*[F.lit(n) for n in READER.names()]))
    return rows.where((F.col("org_id") != READER.org) | ((F.col("access_level") == "restricted") & ~listed)).select("data_id", "org_id")
