"""Queries of writes, selections, ownership, audits and derived records."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from memlake.operators.access import visible
from memlake.operators.lifecycle import account_plan, checked_edges, deletion_selection, digest, merged, write_results
from memlake.plans.lens import ITEMS_SQL, MEMBERS_SQL, READER, items, members
from memlake.plans.registry import query, table


@query("""SELECT doc_id AS key, CASE WHEN source = 'src1' THEN 'dropped' WHEN length(text) > 5000 THEN 'too_large' WHEN doc_id % 3 = 0 THEN 'updated' ELSE 'created' END AS status FROM documents""")
def write_statuses(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.coalesce(F.col("source") != "src1", F.lit(True)).alias("producer_enabled"), F.length("text").alias("chars"))
    return write_results(d, d.where("key % 3 = 0"), 5000).select("key", "status")


@query(f"WITH {ITEMS_SQL} SELECT data_id, data_id % 13 = 0 AS held FROM items WHERE project_id IS NOT NULL AND event_time < TIMESTAMP '2024-01-20' AND list_contains(shared_with, 'group:g1')")
def deletion_plan(spark, sf_dir):
    rows = items(spark, sf_dir).withColumn("legal_hold", F.col("data_id") % 13 == 0)
    due = F.col("project_id").isNotNull() & (F.col("event_time") < F.lit("2024-01-20").cast("timestamp_ntz")) & F.array_contains("shared_with", "group:g1")
    return deletion_selection(rows, due).select("data_id", "held")


@query(f"""WITH {ITEMS_SQL} SELECT data_id, CASE WHEN owner_id <> 'u2' THEN 'not_owner' WHEN access_level IN ('org', 'public') THEN 'organisation_data' WHEN data_id % 13 = 0 THEN 'legal_hold' END AS reason,
  owner_id = 'u2' AND access_level NOT IN ('org', 'public') AND data_id % 13 <> 0 AS deleted_too FROM items""")
def account_deletion(spark, sf_dir):
    return account_plan(items(spark, sf_dir).withColumn("legal_hold", F.col("data_id") % 13 == 0), "u2").select("data_id", "reason", "deleted_too")


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'interpretive' WHEN 3 THEN 'interpretive' ELSE 'structural' END AS class, l_linenumber % 4 = 2 AND l_orderkey % 2 = 0 AS refused FROM lineitem""")
def predicate_check(spark, sf_dir):
    """Suppliers produce parts; customers do not; relations that nobody registered pass."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("uses", "produces", "produces", "likes")]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    subject = F.when(F.col("l_linenumber") % 4 == 0, "customer").when((F.col("l_linenumber") % 4 == 2) & (F.col("l_orderkey") % 2 == 0), "customer").otherwise("supplier")
    edges = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", kind.alias("predicate"), subject.alias("subject_type"), F.lit("part").alias("object_type"))
    return checked_edges(edges).select("l_orderkey", "l_linenumber", "class", "refused")


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 > 1 THEN c_custkey - 1 END AS merged_into FROM customer),
w(id, pos) AS (SELECT id, id FROM e UNION SELECT w.id, merged_into FROM w JOIN e ON e.id = pos WHERE merged_into IS NOT NULL)
SELECT min_at AS survivor, count(*) AS absorbed FROM (SELECT id, min(pos) AS min_at FROM w GROUP BY 1) GROUP BY 1""")
def entity_merges(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 10 > 1, F.col("c_custkey") - 1).alias("merged_into"))
    return merged(c).groupBy("survivor").agg(F.count("*").alias("absorbed"))


@query("""SELECT user_id, count_if(event_type = 'signup') AS added, count_if(event_type = 'error') AS removed, count_if(event_type NOT IN ('signup', 'error')) AS altered,
  max(CASE WHEN value >= 90 THEN 3 WHEN value >= 50 THEN 2 ELSE 1 END)::INT AS rank, string_agg(event_type, ' | ' ORDER BY seq) FILTER (seq <= 5) AS statements
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events) GROUP BY 1""")
def change_digest(spark, sf_dir):
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    kind = F.when(F.col("event_type") == "signup", "added").when(F.col("event_type") == "error", "removed").otherwise("altered")
    weight = F.when(F.col("value") >= 90, "high").when(F.col("value") >= 50, "medium").otherwise("low")
    return digest(table(spark, sf_dir, "events").select("user_id", seq.alias("seq"), kind.alias("kind"), weight.alias("significance"), F.col("event_type").alias("statement")), "user_id")


@query("""WITH a AS (SELECT doc_id AS data_id, CASE doc_id % 3 WHEN 0 THEN 'generate' WHEN 1 THEN 'embed' ELSE 'judge' END AS purpose, 'g' || (doc_id % 4) AS generator FROM documents),
c AS (SELECT * FROM (VALUES ('generate', 'g0'), ('embed', 'g1')) v(purpose, now))
SELECT purpose, count(*) AS artifacts, count_if(generator <> coalesce(now, generator)) AS stale FROM a LEFT JOIN c USING (purpose) GROUP BY 1""")
def stale_artifacts(spark, sf_dir):
    """Artifacts whose generator is not the current one of their purpose; a purpose without one has no stale artifacts."""
    purpose = F.when(F.col("doc_id") % 3 == 0, "generate").when(F.col("doc_id") % 3 == 1, "embed").otherwise("judge")
    now = F.create_map(*[F.lit(x) for x in ("generate", "g0", "embed", "g1")])
    a = table(spark, sf_dir, "documents").select(purpose.alias("purpose"), F.concat(F.lit("g"), F.col("doc_id") % 4).alias("generator"))
    return a.groupBy("purpose").agg(F.count("*").alias("artifacts"), F.count_if(F.col("generator") != F.coalesce(now[F.col("purpose")], F.col("generator"))).alias("stale"))


@query(f"""WITH {ITEMS_SQL}, {MEMBERS_SQL}, g AS (SELECT memory_id, count(DISTINCT m.data_id) AS records, count(DISTINCT s.data_id) AS readable FROM members m LEFT JOIN seen s ON s.data_id = m.data_id % 1000 GROUP BY 1)
SELECT memory_id, records, readable FROM g WHERE readable > 0 OR memory_id LIKE '%7'""")
def memory_listing(spark, sf_dir):
    """Memories with their numbers of members; one without a readable member is listed for its owner only."""
    seen = items(spark, sf_dir).where(visible(READER)).select(F.col("data_id").alias("at"), F.lit(True).alias("open"))
    m = members(spark, sf_dir).withColumn("at", F.col("data_id") % 1000).join(seen, "at", "left")
    g = m.groupBy("memory_id").agg(F.countDistinct("data_id").alias("records"), F.countDistinct(F.when(F.col("open"), F.col("data_id"))).alias("readable"))
    return g.where((F.col("readable") > 0) | F.col("memory_id").endswith("7"))


@query(f"""WITH {MEMBERS_SQL}, n AS (SELECT data_id, count(DISTINCT memory_id) AS held FROM members GROUP BY 1)
SELECT memory_id, count(*) AS members, count_if(added_at + INTERVAL 6 HOUR < TIMESTAMP '2024-01-02' AND held = 1) AS would_expire FROM members JOIN n USING (data_id) GROUP BY 1""")
def retype_preview(spark, sf_dir):
    """Members that a shorter time to live would delete: past it and held by no other memory."""
    m = members(spark, sf_dir)
    held = m.groupBy("data_id").agg(F.countDistinct("memory_id").alias("held"))
    past = F.col("added_at") + F.expr("interval 6 hours") < F.lit("2024-01-02").cast("timestamp_ntz")
    return m.join(held, "data_id").groupBy("memory_id").agg(F.count("*").alias("members"), F.count_if(past & (F.col("held") == 1)).alias("would_expire"))


@query("""WITH k AS (SELECT source, text, length(text) AS n, row_number() OVER (PARTITION BY source, text ORDER BY doc_id DESC) AS r FROM documents)
SELECT source, count(*) AS considered, count_if(r > 1) AS archived, sum(n)::BIGINT AS before, sum(CASE WHEN r = 1 THEN n ELSE 0 END)::BIGINT AS after FROM k GROUP BY 1""")
def compaction_savings(spark, sf_dir):
    """Copies are counted per text first, so that a large group of them is never sorted."""
    g = table(spark, sf_dir, "documents").groupBy("source", "text").agg(F.count("*").alias("n")).withColumn("chars", F.length("text"))
    return g.groupBy("source").agg(F.sum("n").alias("considered"), F.sum(F.col("n") - 1).alias("archived"), F.sum(F.col("n") * F.col("chars")).cast("long").alias("before"), F.sum("chars").cast("long").alias("after"))


@query("""WITH e AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem) SELECT node, count(*) AS degree FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY 1""")
def node_degrees(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b")).distinct()
    return e.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


@query("""SELECT o_orderkey AS meeting, count(c_custkey) AS resolved, count(*) - count(c_custkey) AS unresolved FROM (SELECT o_orderkey, unnest(['CUSTOMER#' || lpad(o_custkey::VARCHAR, 9, '0'), 'guest']) AS who FROM orders)
LEFT JOIN customer ON lower(c_name) = lower(who) GROUP BY 1""")
def attendees(spark, sf_dir):
    who = F.explode(F.array(F.concat(F.lit("CUSTOMER#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")), F.lit("guest")))
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("meeting"), who.alias("who")).withColumn("name", F.lower("who"))
    known = table(spark, sf_dir, "customer").select(F.lower("c_name").alias("name"), "c_custkey")
    return asked.join(known, "name", "left").groupBy("meeting").agg(F.count("c_custkey").alias("resolved"), (F.count("*") - F.count("c_custkey")).alias("unresolved"))


@query(f"""WITH {ITEMS_SQL}, m AS (SELECT event_id AS sequence, event_id % 1000 AS data_id FROM events WHERE event_id > 5000 AND event_type = 'purchase' ORDER BY 1 LIMIT 100)
SELECT sequence, CASE WHEN data_id IN (SELECT data_id FROM seen) THEN data_id END AS data_id, data_id NOT IN (SELECT data_id FROM seen) AS withheld FROM m""")
def match_feed(spark, sf_dir):
    """The next hundred matches after a cursor; one that the reader may not see shows its place and nothing else."""
    m = table(spark, sf_dir, "events").where("event_id > 5000 and event_type = 'purchase'").select(F.col("event_id").alias("sequence"), (F.col("event_id") % 1000).alias("at")).orderBy("sequence").limit(100)
    seen = items(spark, sf_dir).where(visible(READER)).select(F.col("data_id").alias("at"), "data_id")
    return m.join(seen, "at", "left").select("sequence", "data_id", F.col("data_id").isNull().alias("withheld"))


@query("""SELECT user_id AS worker, max(ts) AS beat, max(ts) < TIMESTAMP '2024-01-11 09:00:00' - INTERVAL 300 SECOND AS reaped FROM events WHERE ts <= TIMESTAMP '2024-01-11 09:00:00' GROUP BY 1""")
def reap_stale(spark, sf_dir):
    now = F.lit("2024-01-11 09:00:00").cast("timestamp_ntz")
    g = table(spark, sf_dir, "events").where(F.col("ts") <= now).groupBy(F.col("user_id").alias("worker")).agg(F.max("ts").alias("beat"))
    return g.withColumn("reaped", F.col("beat") < now - F.expr("interval 300 seconds"))
