"""Queries of sources and formats."""

from pyspark.sql import functions as F

from memlake.operators.written import dealt
from memlake.plans.registry import query, table
from memlake.sources.feeds import delivered_items, fetch_refusal, rebuilt_text, repository, run_watermarks, traverse, video_id
from memlake.sources.formats import dependencies, file_kind, jsonl


@query("""WITH d AS (SELECT event_id % 700 AS delivery_id, min(event_id) AS e FROM events GROUP BY 1), i AS (SELECT delivery_id, e, unnest([0, 1]) AS n FROM d)
SELECT delivery_id, e || '-' || n AS item_id, event_type AS body, floor(epoch(ts))::BIGINT AS occurred FROM i JOIN events ON event_id = e""")
def webhook_items(spark, sf_dir):
    """Repeated deliveries count once; times arrive in seconds or in milliseconds."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    item = lambda n, time: F.struct(F.concat_ws("-", "event_id", F.lit(n)).alias("id"), F.struct(F.col("event_type").alias("text")).alias("body"), time.alias("at"))
    payload = F.to_json(F.struct(F.array(item(0, seconds), item(1, seconds * 1000)).alias("items")))
    deliveries = table(spark, sf_dir, "events").select((F.col("event_id") % 700).alias("delivery_id"), F.col("event_id").alias("received"), payload.alias("payload"))
    return delivered_items(deliveries, "items", "id", "body.text", "at")


@query("SELECT doc_id AS data_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL")
def inverted_text(spark, sf_dir):
    """Texts rebuilt from an index of words and their positions are the texts."""
    texts = dealt(table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("data_id"), "text"), ["data_id"], 2048)
    placed = texts.select("data_id", F.posexplode(F.split("text", " ")).alias("at", "word"))
    postings = placed.groupBy("data_id", "word").agg(F.collect_list("at").alias("positions"))
    return rebuilt_text(postings).select("data_id", F.sha2("text", 256).alias("digest"))


@query(r"""WITH RECURSIVE l AS (SELECT DISTINCT regexp_extract(url, '^([a-z]+://[^/]+)', 1) AS source, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS path FROM pages),
e AS (SELECT DISTINCT source AS a, path AS b FROM l UNION SELECT DISTINCT path, source FROM l),
w(url, step) AS (SELECT DISTINCT regexp_extract(url, '^([a-z]+://[^/]+)', 1), 0 FROM pages WHERE page_id < 3 UNION SELECT b, step + 1 FROM w JOIN e ON a = url WHERE step < 2)
SELECT url, min(step)::INT AS step FROM w GROUP BY 1""")
def page_links_bfs(spark, sf_dir):
    """From three sites to the paths they link, and to the sites that link the same paths."""
    site = F.regexp_extract("url", "^([a-z]+://[^/]+)", 1)
    p = table(spark, sf_dir, "pages")
    links = p.select(site.alias("source"), F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))).alias("target")).distinct()
    both = links.union(links.select(F.col("target").alias("source"), F.col("source").alias("target")))
    return traverse(both, p.where("page_id < 3").select(site.alias("url")), 2)


@query("""WITH r AS (SELECT event_type AS crawler, event_id // 200 AS run, lpad(event_id::VARCHAR, 8, '0') AS version, event_id % 997 <> 0 AND event_id // 200 % 5 <> 3 AS ok FROM events),
g AS (SELECT crawler, run, max(version) AS version, bool_and(ok) AS whole, bool_or(ok) AS parts FROM r GROUP BY 1, 2)
SELECT crawler, run, CASE WHEN whole THEN 'ok' WHEN parts THEN 'partial' ELSE 'failed' END AS status,
  max(CASE WHEN whole THEN version END) OVER (PARTITION BY crawler ORDER BY run) AS watermark FROM g""")
def crawl_watermark(spark, sf_dir):
    run = F.floor(F.col("event_id") / 200)
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("crawler"), run.alias("run"), F.lpad(F.col("event_id").cast("string"), 8, "0").alias("version"), ((F.col("event_id") % 997 != 0) & (run % 5 != 3)).alias("ok"))
    return run_watermarks(e)


@query("""WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'ftp' || substr(url, 5) WHEN 2 THEN 'http://10.0.0.' || page_id || '/x' ELSE 'https://db.internal:8080/' || page_id END AS u FROM pages)
SELECT page_id, CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'scheme' ELSE 'private' END AS refusal FROM u""")
def fetch_guard(spark, sf_dir):
    kind, n = F.col("page_id") % 4, F.col("page_id").cast("string")
    url = F.when(kind == 0, F.col("url")).when(kind == 1, F.concat(F.lit("ftp"), F.expr("substr(url, 5)"))).when(kind == 2, F.concat(F.lit("http://10.0.0."), n, F.lit("/x"))).otherwise(F.concat(F.lit("https://db.internal:8080/"), n))
    return table(spark, sf_dir, "pages").select("page_id", fetch_refusal(url).alias("refusal"))


@query("""SELECT page_id, CASE WHEN page_id % 3 < 2 THEN lpad(page_id::VARCHAR, 11, 'v') END AS video, CASE WHEN page_id % 3 = 2 THEN 'owner/repo' || page_id END AS repo FROM pages""")
def url_ids(spark, sf_dir):
    kind, n = F.col("page_id") % 3, F.col("page_id").cast("string")
    v = F.lpad(n, 11, "v")
    url = F.when(kind == 0, F.concat(F.lit("https://youtu.be/"), v)).when(kind == 1, F.concat(F.lit("https://www.youtube.com/watch?t=3&v="), v)).otherwise(F.concat(F.lit("git@github.com:owner/repo"), n, F.lit(".git")))
    return table(spark, sf_dir, "pages").select("page_id", video_id(url).alias("video"), repository(url).alias("repo"))


@query("""SELECT doc_id AS data_id, CASE doc_id % 6 WHEN 0 THEN 'code:python' WHEN 1 THEN 'blocked' WHEN 2 THEN 'needs_model' WHEN 3 THEN 'csv' WHEN 4 THEN 'text' ELSE 'code:sql' END AS kind FROM documents""")
def file_kinds(spark, sf_dir):
    kind, n = F.col("doc_id") % 6, F.col("doc_id").cast("string")
    ending = F.element_at(F.array(*[F.lit(x) for x in (".py", ".xlsm", ".png", ".CSV", "", ".sql")]), (kind + 1).cast("int"))
    mime = F.when(kind == 2, "image/png").otherwise("application/octet-stream")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("data_id"), file_kind(F.concat(F.lit("f"), n, ending), mime).alias("kind"))


@query("SELECT event_id // 50 AS data_id, count(*) AS lines, count_if(event_type = 'error') AS bad FROM events GROUP BY 1")
def jsonl_lines(spark, sf_dir):
    """Fifty events make a file of JSON lines; error lines are broken off."""
    line = F.when(F.col("event_type") == "error", '{"k": ').otherwise(F.col("props"))
    files = table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 50).alias("data_id")).agg(F.array_join(F.collect_list(line), "\n").alias("text"))
    return jsonl(files).groupBy("data_id").agg(F.count("*").alias("lines"), F.count_if("bad").alias("bad"))


@query("""SELECT s_suppkey AS data_id, unnest(CASE s_suppkey % 3 WHEN 0 THEN ['lib' || s_suppkey, 'core'] WHEN 1 THEN ['example.org/m' || s_suppkey] ELSE ['a', 'b' || s_suppkey] END) AS package FROM supplier""")
def manifest_dependencies(spark, sf_dir):
    kind, n = F.col("s_suppkey") % 3, F.col("s_suppkey").cast("string")
    name = F.element_at(F.array(F.lit("requirements.txt"), F.lit("go.mod"), F.lit("package.json")), (kind + 1).cast("int"))
    text = F.when(kind == 0, F.concat(F.lit("# needed\nlib"), n, F.lit(">=1.0\ncore\n"))).when(kind == 1, F.concat(F.lit("module x\nrequire example.org/m"), n, F.lit(" v1.2.0\n"))).otherwise(F.concat(F.lit('{"dependencies": {"a": "1", "b'), n, F.lit('": "^2"}}')))
    return dependencies(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("data_id"), name.alias("name"), text.alias("text")))
