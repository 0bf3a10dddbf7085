"""Entities, claims and walks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from memlake.functions.names import normalize_identifier, normalize_name
from memlake.operators.graph import co_mentioned, conflicts, evidence_of, holds_at, neighbourhood, supersede
from memlake.operators.written import dealt
from memlake.plans.lens import CLAIMS_SQL, claims
from memlake.plans.registry import query, table


@query("""SELECT c_custkey AS id, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS name, rtrim(regexp_replace(lower(trim('MAILTO:' || c_name || '@X.ORG/')), '^mailto:', ''), '/') AS identifier FROM customer""")
def entity_normalize(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    mail = F.concat(F.lit("MAILTO:"), "c_name", F.lit("@X.ORG/"))
    return c.select(F.col("c_custkey").alias("id"), normalize_name(F.col("c_name")).alias("name"), normalize_identifier(mail).alias("identifier"))


@query("""WITH m AS (SELECT o_orderkey AS data_id, 'customer ' || lpad((o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 10000000 ELSE 0 END)::VARCHAR, 9, '0') AS name FROM orders),
e AS (SELECT min(c_custkey) AS entity_id, replace(lower(c_name), '#', ' ') AS name FROM customer GROUP BY 2)
SELECT m.data_id, e.entity_id, e.entity_id IS NULL AS created FROM m LEFT JOIN e USING (name)""")
def entity_resolve(spark, sf_dir):
    """Mentions to entities by their normal form; a mention without a match would create one."""
    unknown = F.when(F.col("o_orderkey") % 5 == 0, 10_000_000).otherwise(0)
    written = F.concat(F.lit("Dr. CUSTOMER-"), F.lpad((F.col("o_custkey") + unknown).cast("string"), 9, "0"), F.lit(", Jr."))
    m = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("data_id"), normalize_name(written).alias("name"))
    e = table(spark, sf_dir, "customer").groupBy(normalize_name(F.col("c_name")).alias("name")).agg(F.min("c_custkey").alias("entity_id"))
    return m.join(e, "name", "left").select("data_id", "entity_id", F.col("entity_id").isNull().alias("created"))


@query("""SELECT c_custkey AS entity_id, c_name AS name, count(DISTINCT o_orderkey) AS mentions, max(o_orderdate) AS last_seen
  FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 100""")
def entity_list(spark, sf_dir):
    seen = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("entity_id")).agg(F.countDistinct("o_orderkey").alias("mentions"), F.max("o_orderdate").alias("last_seen"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name"))
    return seen.join(c, "entity_id").orderBy(F.desc("mentions"), "entity_id").limit(100).select("entity_id", "name", "mentions", "last_seen")


@query("""SELECT o.l_partkey AS entity, count(DISTINCT o.l_orderkey) AS records FROM lineitem m JOIN lineitem o ON m.l_orderkey = o.l_orderkey
  WHERE m.l_partkey = 1 AND o.l_partkey <> 1 GROUP BY 1""")
def comention(spark, sf_dir):
    return co_mentioned(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity"), F.col("l_orderkey").alias("data_id")), 1)


@query(f"""WITH {CLAIMS_SQL} SELECT subject, object, count(DISTINCT fact_id) AS evidence, min(valid_from) AS valid_from, max(valid_from) AS last_seen,
  array_to_string(list_sort(list(DISTINCT fact_id))[1:3], ',') AS sources FROM claims GROUP BY 1, 2""")
def fact_evidence(spark, sf_dir):
    return evidence_of(claims(spark, sf_dir))


#: Claims one after another over the list of a subject's facts.
_SUPERSEDE_SQL = f"""WITH RECURSIVE {CLAIMS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY fact_id) AS i FROM claims),
f AS (SELECT DISTINCT subject, 0::BIGINT AS i, []::STRUCT(o VARCHAR, id BIGINT, s TIMESTAMP, e TIMESTAMP, n INT)[] AS facts FROM claims
  UNION ALL SELECT subject, i, list_transform(met, lambda x: CASE WHEN x.o <> object AND x.e IS NULL AND x.s < valid_from THEN struct_pack(o := x.o, id := x.id, s := x.s, e := valid_from, n := x.n) ELSE x END) FROM (
    SELECT n.subject, n.i, n.object, n.valid_from::TIMESTAMP AS valid_from, CASE WHEN len(list_filter(facts, lambda x: x.o = n.object AND x.e IS NULL)) > 0
      THEN list_transform(facts, lambda x: CASE WHEN x.o = n.object AND x.e IS NULL THEN struct_pack(o := x.o, id := x.id, s := least(x.s, n.valid_from::TIMESTAMP), e := x.e, n := x.n + 1) ELSE x END)
      ELSE list_append(facts, struct_pack(o := n.object, id := n.fact_id, s := n.valid_from::TIMESTAMP, e := NULL::TIMESTAMP, n := 1)) END AS met
    FROM f JOIN n ON n.subject = f.subject AND n.i = f.i + 1)),
l AS (SELECT subject, unnest(facts) AS x FROM (SELECT * FROM f QUALIFY i = max(i) OVER (PARTITION BY subject)))
SELECT subject, x.o AS object, x.id AS fact_id, x.s AS valid_from, x.e AS valid_to, x.n AS evidence FROM l"""


@query(_SUPERSEDE_SQL)
def fact_supersession(spark, sf_dir):
    return supersede(claims(spark, sf_dir))


@query(f"""WITH {CLAIMS_SQL}, f AS (SELECT subject, object, min(valid_from) AS valid_from FROM claims GROUP BY 1, 2)
SELECT subject, count(*) AS claims, string_agg(object, ',' ORDER BY valid_from, object) AS objects FROM f GROUP BY 1 HAVING count(*) > 1""")
def fact_conflicts(spark, sf_dir):
    facts = claims(spark, sf_dir).groupBy("subject", "object").agg(F.min("valid_from").alias("valid_from")).withColumn("valid_to", F.lit(None).cast("timestamp_ntz"))
    return conflicts(facts)


@query(f"""WITH {CLAIMS_SQL}, f AS (SELECT *, lead(valid_from) OVER (PARTITION BY subject ORDER BY valid_from, fact_id) AS valid_to FROM claims)
SELECT subject, object, fact_id FROM f WHERE valid_from <= TIMESTAMP '1996-07-01' AND (valid_to IS NULL OR TIMESTAMP '1996-07-01' < valid_to)""")
def facts_as_of(spark, sf_dir):
    end = F.lead("valid_from").over(Window.partitionBy("subject").orderBy("valid_from", "fact_id"))
    return claims(spark, sf_dir).withColumn("valid_to", end).where(holds_at(F.lit("1996-07-01").cast("timestamp_ntz"))).select("subject", "object", "fact_id")


_EDGES_SQL = """edges AS (SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""


def _edges(spark, sf_dir):
    pair = lambda t, p, k, q, v: table(spark, sf_dir, t).select(F.concat(F.lit(p), k).alias("a"), F.concat(F.lit(q), v).alias("b"))
    return pair("customer", "c", "c_custkey", "n", "c_nationkey").union(pair("supplier", "s", "s_suppkey", "n", "s_nationkey")).union(pair("nation", "n", "n_nationkey", "r", "n_regionkey"))


@query(f"""WITH RECURSIVE {_EDGES_SQL}, both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
walk(id, hops) AS (SELECT 'c1', 0 UNION SELECT b, hops + 1 FROM walk JOIN both_ways ON a = id WHERE hops < 2)
SELECT id, min(hops)::INT AS hops FROM walk GROUP BY 1""")
def neighbourhood_2hop(spark, sf_dir):
    return neighbourhood(_edges(spark, sf_dir), spark.createDataFrame([("c1",)], "id string"), 2)


@query("""SELECT l_suppkey AS subject, l_partkey AS object, count(DISTINCT l_orderkey) AS evidence, max(l_shipdate) AS last_seen FROM lineitem
  GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 200""")
def graph_overview(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("subject"), F.col("l_partkey").alias("object"), "l_orderkey", "l_shipdate")
    return dealt(lines, ["subject", "object"], 1 << 18).groupBy("subject", "object").agg(F.countDistinct("l_orderkey").alias("evidence"), F.max("l_shipdate").alias("last_seen")).orderBy(F.desc("evidence"), "subject", "object").limit(200)


@query("""WITH n AS (SELECT c_nationkey AS k FROM customer WHERE c_custkey = 1), near AS (SELECT c_custkey AS entity, CASE WHEN c_custkey = 1 THEN 0 ELSE 1 END AS hops FROM customer JOIN n ON c_nationkey = k)
SELECT data_id, hops, mentions, (1.0 / (1 + hops))::DOUBLE AS score, row_number() OVER (ORDER BY hops, mentions DESC, data_id)::INT AS rank FROM (
  SELECT o_orderdate::DATE AS data_id, min(hops) AS hops, count(*) AS mentions FROM orders JOIN near ON o_custkey = entity GROUP BY 1) QUALIFY rank <= 40""")
def graph_arm(spark, sf_dir):
    """Records (order days) that mention the seed customer or one of the same nation: least hops, then most mentions."""
    c = table(spark, sf_dir, "customer")
    near = c.join(F.broadcast(c.where("c_custkey = 1").select("c_nationkey")), "c_nationkey", "left_semi").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_custkey") == 1, 0).otherwise(1).alias("hops"))
    days = table(spark, sf_dir, "orders").join(near, "o_custkey").groupBy(F.to_date("o_orderdate").alias("data_id")).agg(F.min("hops").alias("hops"), F.count("*").alias("mentions"))
    order = [F.asc("hops"), F.desc("mentions"), F.asc("data_id")]
    top = days.orderBy(*order).limit(40)
    return top.select("data_id", "hops", "mentions", (1.0 / (1 + F.col("hops"))).alias("score"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).alias("rank"))
