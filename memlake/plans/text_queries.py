"""Queries of text conditions, citations and extraction."""

from pyspark.sql import functions as F

from memlake.functions.text import cited, keywords, matches, window_spans
from memlake.operators.access import visible
from memlake.plans.lens import ITEMS_SQL, READER, items
from memlake.plans.registry import query, table

STOP = ("this", "that", "with", "from", "have", "were", "they", "their")


@query(f"""WITH {ITEMS_SQL}, w AS (SELECT data_id, list_transform(regexp_extract_all(lower(text), '[a-z0-9]+'),
  lambda x: regexp_replace(CASE WHEN regexp_matches(x, '[a-z]{{3}}ies$') THEN left(x, -3) || 'y' WHEN regexp_matches(x, '[a-z]{{3}}ing$') THEN left(x, -3) WHEN regexp_matches(x, '[a-z]{{3}}ed$') THEN left(x, -2) ELSE x END, '([a-z]{{2}}[a-rt-z])s$', '\\1')) AS w FROM seen)
SELECT data_id FROM w WHERE list_has_any(w, ['the', 'le', 'der', 'el']) AND NOT list_has_any(w, ['license', 'email']) AND list_has_all(w, ['to'])""")
def text_search(spark, sf_dir):
    found = matches(F.col("text"), all_of=("to",), any_of=("the", "le", "der", "el"), none_of=("licenses", "emailed"))
    return items(spark, sf_dir).where(visible(READER) & found).select("data_id")


@query("""WITH a AS (SELECT doc_id AS data_id, doc_id % 4 AS n, 'see [1] and [' || (doc_id % 6) || '], also [1]' AS answer FROM documents)
SELECT data_id, CASE WHEN n = 0 THEN '' WHEN data_id % 6 BETWEEN 2 AND n THEN '1,' || (data_id % 6) ELSE '1' END AS used, n > 0 AS grounded,
  n - (CASE WHEN n = 0 THEN 0 WHEN data_id % 6 BETWEEN 2 AND n THEN 2 ELSE 1 END) AS retrieved_not_cited FROM a""")
def answer_citations(spark, sf_dir):
    """Markers count if they name a passage; passages without a marker were retrieved and not cited."""
    n = F.col("doc_id") % 4
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("data_id"), n.alias("n"), F.concat(F.lit("see [1] and ["), (F.col("doc_id") % 6).cast("string"), F.lit("], also [1]")).alias("answer"))
    a = a.withColumn("used", cited(F.col("answer"), F.col("n")))
    return a.select("data_id", F.array_join("used", ",").alias("used"), (F.size("used") > 0).alias("grounded"), (F.col("n") - F.size("used")).alias("retrieved_not_cited"))


@query(f"""WITH {ITEMS_SQL}, p AS (SELECT project_id, count(*) AS records, count_if(data_id IN (SELECT data_id FROM seen)) AS own,
  count_if(data_id IN (SELECT data_id FROM seen WHERE text <> '')) AS searchable, count_if(data_id IN (SELECT data_id FROM seen WHERE contains(lower(text), 'license'))) AS hits FROM items GROUP BY 1)
SELECT project_id, CASE WHEN own = 0 THEN 'none_in_scope' WHEN searchable = 0 THEN 'none_searchable' WHEN hits = 0 THEN 'no_match' ELSE 'answered' END AS reason FROM p""")
def answer_reason(spark, sf_dir):
    """Why a question has no answer, the first reason that holds."""
    seen = visible(READER)
    g = items(spark, sf_dir).groupBy("project_id").agg(F.count_if(seen).alias("own"), F.count_if(seen & (F.col("text") != "")).alias("searchable"), F.count_if(seen & F.contains(F.lower("text"), F.lit("license"))).alias("hits"))
    reason = F.when(F.col("own") == 0, "none_in_scope").when(F.col("searchable") == 0, "none_searchable").when(F.col("hits") == 0, "no_match").otherwise("answered")
    return g.select("project_id", reason.alias("reason"))


@query(f"""WITH t AS (SELECT doc_id AS data_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents), x AS (SELECT data_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM t),
c AS (SELECT data_id, word, count(*) AS n, min(pos) AS met FROM x WHERE length(word) > 3 AND word NOT IN {STOP} GROUP BY 1, 2)
SELECT data_id, row_number() OVER (PARTITION BY data_id ORDER BY n DESC, met)::INT AS rank, word, n FROM c QUALIFY rank <= 8""")
def heuristic_keywords(spark, sf_dir):
    return keywords(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("data_id"), "text"), STOP)


@query("SELECT doc_id AS data_id, length(text) AS covered, true AS joined FROM documents WHERE length(text) > 0")
def extraction_windows(spark, sf_dir):
    """Windows follow each other without gaps and cover the whole text."""
    d = table(spark, sf_dir, "documents").where("length(text) > 0").select(F.col("doc_id").alias("data_id"), window_spans(F.col("text"), 1000).alias("s"))
    follow = F.forall(F.sequence(F.lit(1), F.greatest(F.size("s") - 1, F.lit(1))), lambda i: F.coalesce(F.get("s", i)["start"] == F.get("s", i - 1)["end"], F.lit(True)))
    return d.select("data_id", F.element_at("s", -1)["end"].cast("long").alias("covered"), follow.alias("joined"))


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 2 * ceil(l / 20.0) WHEN 'click' THEN 2 * ceil(l / 20.0) + 200 WHEN 'purchase' THEN 10 * l ELSE l END::BIGINT AS credits
FROM (SELECT event_id, event_type, event_id % 57 + 1 AS l FROM events)""")
def credit_estimates(spark, sf_dir):
    """What a call is expected to cost: two signals a page of twenty, an answer on top, ten for each enriched write, one for others."""
    limit, kind = F.col("event_id") % 57 + 1, F.col("event_type")
    pages = F.ceil(limit / 20) * 2
    return table(spark, sf_dir, "events").select("event_id", F.when(kind == "view", pages).when(kind == "click", pages + 200).when(kind == "purchase", limit * 10).otherwise(limit).cast("long").alias("credits"))


@query("""WITH t AS (SELECT p_partkey, p_brand AS brand, unnest(list_distinct(string_split(lower(p_name), ' '))) AS w FROM part),
c AS (SELECT a.p_partkey AS candidate, count(DISTINCT a.w) AS common FROM t a JOIN t b ON a.w = b.w AND b.p_partkey = 1 WHERE a.p_partkey <> 1 GROUP BY 1) SELECT candidate, common FROM c WHERE common >= 2""")
def title_match(spark, sf_dir):
    """Candidates that share two or more title words with the one sought."""
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("candidate"), F.explode(F.array_distinct(F.split(F.lower("p_name"), " "))).alias("word"))
    sought = t.where("candidate = 1").select("word")
    common = t.where("candidate <> 1").join(F.broadcast(sought), "word").groupBy("candidate").agg(F.countDistinct("word").alias("common"))
    return common.where("common >= 2")
