"""Entity resolution by identifier and name, merges and their undoing."""

from pyspark.sql import functions as F

from memlake.operators.entities import entities, merged, resolve
from memlake.plans.registry import query, table

#: Customers as mentions: two halves share their names, three neighbours an identifier; some have titles, some no identifier, some an unknown type.
_MENTIONS_SQL = """n AS (SELECT count(*) AS n FROM customer),
c AS (SELECT c_custkey AS data_id, 0 AS seq, CASE c_custkey % 3 WHEN 0 THEN 'Dr. ' ELSE '' END || 'Customer#' || lpad(((c_custkey * 2) % n)::VARCHAR, 9, '0') AS surface,
  CASE WHEN c_nationkey % 6 = 5 THEN 'alien' WHEN c_nationkey % 2 = 0 THEN 'person' ELSE 'organization' END AS type, lpad(((c_custkey * 2) % n)::VARCHAR, 9, '0') AS digits,
  CASE WHEN c_custkey % 5 < 2 THEN 'u' || (c_custkey // 3) || '@x.org' END AS identifier FROM customer, n),
k AS (SELECT *, type || ':customer ' || digits AS key FROM c WHERE type <> 'alien'),
links AS (SELECT DISTINCT key AS a, '~' || identifier AS b FROM k WHERE identifier IS NOT NULL),
reach(id, other) AS (SELECT a, a FROM links UNION SELECT r.id, m.a FROM reach r JOIN links l ON l.a = r.other JOIN links m ON m.b = l.b),
label AS (SELECT id, min(other) AS entity FROM reach GROUP BY 1),
e AS (SELECT k.*, coalesce(entity, key) AS entity FROM k LEFT JOIN label ON id = key),
shared AS (SELECT identifier, count(*) > 1 AS shared FROM k WHERE identifier IS NOT NULL GROUP BY 1),
m AS (SELECT data_id, surface, e.type, e.entity, CASE WHEN data_id = min(data_id) OVER (PARTITION BY e.entity) THEN 'new' WHEN shared THEN 'identifier' ELSE 'exact_name' END AS resolved_by FROM e LEFT JOIN shared USING (identifier))"""


def _mentions(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    n = c.count()
    kind = F.when(F.col("c_nationkey") % 6 == 5, "alien").when(F.col("c_nationkey") % 2 == 0, "person").otherwise("organization")
    name = F.concat(F.when(F.col("c_custkey") % 3 == 0, "Dr. ").otherwise(""), F.lit("Customer#"), F.lpad((F.col("c_custkey") * 2 % n).cast("string"), 9, "0"))
    identifier = F.when(F.col("c_custkey") % 5 < 2, F.concat(F.lit("mailto:U"), F.expr("c_custkey div 3").cast("string"), F.lit("@X.org/")))
    return resolve(c.select(F.col("c_custkey").alias("data_id"), F.lit(0).alias("seq"), name.alias("name"), kind.alias("type"), identifier.alias("identifier")))


@query(f"WITH RECURSIVE {_MENTIONS_SQL} SELECT data_id, surface, type, entity, resolved_by FROM m")
def entity_mentions(spark, sf_dir):
    return _mentions(spark, sf_dir).select("data_id", "surface", "type", "entity", "resolved_by")


@query(f"""WITH RECURSIVE {_MENTIONS_SQL}, j AS (SELECT entity AS source, lead(entity) OVER (ORDER BY entity) AS target FROM (SELECT DISTINCT entity FROM m WHERE entity LIKE '%0' OR entity LIKE '%4')),
moved AS (SELECT m.*, CASE WHEN m.entity IN (SELECT source FROM j WHERE target IS NOT NULL AND source LIKE '%0') AND target NOT LIKE '%0' THEN target ELSE m.entity END AS now FROM m LEFT JOIN j ON source = m.entity)
SELECT now AS entity, min_by(surface, (-length(surface), surface)) AS display_name, split_part(now, ':', 1) AS type, count(*) AS mentions, count(DISTINCT data_id) AS records FROM moved GROUP BY now""")
def entities_after_merges(spark, sf_dir):
    """Entities whose name ends in 0 merged into the next one that ends in 4; merges into another that ends in 0 were undone."""
    from pyspark.sql import Window

    mentions = _mentions(spark, sf_dir)
    some = mentions.select("entity").where("entity like '%0' or entity like '%4'").distinct()
    pairs = some.withColumn("target", F.lead("entity").over(Window.partitionBy(F.lit(0)).orderBy("entity"))).where("target is not null and entity like '%0'")
    journal = pairs.select(F.col("entity").alias("merge_id"), F.col("entity").alias("source"), "target", F.col("target").like("%0").alias("undone"))
    return entities(merged(mentions, journal))
