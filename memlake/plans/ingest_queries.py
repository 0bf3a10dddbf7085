"""Ingest, parsing and projection."""

from pyspark.sql import functions as F

from memlake.plans.registry import query, table
from memlake.sources.parsing import classify, html_text, turns


@query("""SELECT key, data_id, created FROM (SELECT lang || '/' || source || '/' || (doc_id % 40) AS key, doc_id AS data_id,
  NOT EXISTS (SELECT 1 FROM documents p WHERE p.lang = d.lang AND p.source = d.source AND p.doc_id % 40 = d.doc_id % 40 AND p.doc_id < 300) AS created,
  row_number() OVER (PARTITION BY lang, source, doc_id % 40 ORDER BY doc_id DESC) AS r FROM documents d WHERE doc_id >= 300) WHERE r = 1""")
def natural_key_upsert(spark, sf_dir):
    """The latest write of each natural key, and whether the key was new: an ordered aggregate, then an anti-join flag."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "lang", "source", (F.col("doc_id") % 40).cast("string")).alias("key"))
    before = d.where("doc_id < 300").select("key", F.lit(False).alias("fresh")).distinct()
    latest = d.where("doc_id >= 300").groupBy("key").agg(F.max("doc_id").alias("data_id"))
    return latest.join(before, "key", "left").select("key", "data_id", F.coalesce("fresh", F.lit(True)).alias("created"))


@query("""WITH w AS (SELECT event_id, user_id % 50 || ':' || event_type AS key, props AS body, first_value(props) OVER (PARTITION BY user_id % 50, event_type ORDER BY event_id) AS first_body,
  min(event_id) OVER (PARTITION BY user_id % 50, event_type) AS first_id FROM events)
SELECT event_id, CASE WHEN event_id = first_id THEN 'stored' WHEN body = first_body THEN 'replayed' ELSE 'conflict' END AS outcome FROM w""")
def idempotent_replay(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.concat_ws(":", (F.col("user_id") % 50).cast("string"), "event_type").alias("key"), F.sha2("props", 256).alias("hash"))
    first = e.groupBy("key").agg(F.min("event_id").alias("first_id"), F.min_by("hash", "event_id").alias("first_hash"))
    return e.join(first, "key").select("event_id", F.when(F.col("event_id") == F.col("first_id"), "stored").when(F.col("hash") == F.col("first_hash"), "replayed").otherwise("conflict").alias("outcome"))


@query("""WITH i AS (SELECT doc_id AS id, text AS body, CASE WHEN doc_id % 5 = 0 THEN 'manual' END AS declared, CASE WHEN doc_id % 3 = 0 THEN 'chat' END AS memory_default,
    CASE doc_id % 4 WHEN 0 THEN 'text/csv' WHEN 1 THEN 'text/html' WHEN 2 THEN 'application/x-other' END AS claimed FROM documents
  UNION ALL SELECT 1000000 + page_id, html, NULL, NULL, CASE WHEN page_id % 2 = 0 THEN 'text/csv' ELSE 'text/html' END FROM pages),
s AS (SELECT *, CASE WHEN trim(body, ' ' || chr(9) || chr(10) || chr(13)) = '' OR (regexp_matches(body, '^\\s*[{{\\[]') AND right(body, 1) IN ('}}', ']')) THEN 'application/json'
    WHEN regexp_matches(lower(left(body, 1024)), '^\\s*(<!doc|<html)') OR (regexp_matches(lower(left(body, 1024)), '^\\s*(<[?]xml|<!--)') AND contains(lower(left(body, 1024)), '<html')) THEN 'text/html' ELSE 'text/plain' END AS real FROM i),
k AS (SELECT *, CASE real WHEN 'text/html' THEN 'page' WHEN 'application/json' THEN 'record' ELSE 'note' END AS by_real,
    CASE WHEN real = 'text/plain' OR claimed = real THEN CASE claimed WHEN 'text/html' THEN 'page' WHEN 'text/csv' THEN 'table' END END AS believed FROM s)
SELECT id, coalesce(declared, memory_default, believed, by_real) AS kind, CASE WHEN declared IS NOT NULL THEN 1 WHEN memory_default IS NOT NULL THEN 3 WHEN believed IS NOT NULL THEN 4 ELSE 5 END AS layer FROM k""")
def classify_cascade(spark, sf_dir):
    d, p = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    claimed = F.when(F.col("doc_id") % 4 == 0, "text/csv").when(F.col("doc_id") % 4 == 1, "text/html").when(F.col("doc_id") % 4 == 2, "application/x-other")
    docs = d.select(F.col("doc_id").alias("id"), classify(F.when(F.col("doc_id") % 5 == 0, "manual"), F.when(F.col("doc_id") % 3 == 0, "chat"), claimed, F.col("text")).alias("c"))
    none = F.lit(None).cast("string")
    pages = p.select((F.col("page_id") + 1_000_000).alias("id"), classify(none, none, F.when(F.col("page_id") % 2 == 0, "text/csv").otherwise("text/html"), F.col("html")).alias("c"))
    return docs.union(pages).select("id", "c.kind", "c.layer")


@query()
def html_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html_text(F.col("html")).alias("p")).select("page_id", "p.title", F.array_join("p.headings", "|").alias("headings"), "p.text")


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) LIKE '%example.com' AS in_scope FROM pages""")
def url_scope(spark, sf_dir):
    host = F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), host.endswith("example.com").alias("in_scope"))


@query("""SELECT page_id, count(*) AS links, count(DISTINCT h) AS targets FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS h FROM pages) GROUP BY 1""")
def page_links(spark, sf_dir):
    hrefs = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(hrefs).alias("h")).groupBy("page_id").agg(F.count("*").alias("links"), F.countDistinct("h").alias("targets"))


@query("""WITH n AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS new FROM conversations),
r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM n)
SELECT conv_id, role, min(turn) AS first_turn, count(*) AS n, string_agg(text, ' ' ORDER BY turn) AS text FROM r GROUP BY conv_id, run, role""")
def transcript_turns(spark, sf_dir):
    return turns(table(spark, sf_dir, "conversations"))


@query("""SELECT event_id, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'failed' ELSE 'ok' END AS status, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  event_type || ':' || json_extract_string(props, '$.k') AS identifier FROM events""")
def json_projection(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", F.when(k.isNull(), "failed").otherwise("ok").alias("status"), k.try_cast("bigint").alias("k"), F.concat("event_type", F.lit(":"), k).alias("identifier"))
