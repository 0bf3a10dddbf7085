"""The erasure cascade over fourteen stores and its proof."""

from pyspark.sql import functions as F

from memlake.operators.erasure import Mark, Reference, Registry, proof, purge
from memlake.operators.written import written
from memlake.plans.lens import ITEMS_SQL, items
from memlake.plans.registry import query, table

AT = "2024-07-01"

REGISTRY = Registry(
    "records",
    {"records": "data_id", "chunks": "chunk_id", "embeddings": "vec_id", "versions": "version_id", "artifact_sources": "source_id", "artifacts": "artifact_id", "query_sources": "seen_id", "queries": "query_id",
     "memory_members": "member_id", "case_members": "member_id", "entity_mentions": "mention_id", "entity_edges": "edge_id", "entity_facts": "fact_id", "normalized_records": "norm_id", "share_links": "link_id"},
    (Reference("chunks", "data_id", "records"), Reference("embeddings", "chunk_id", "chunks"), *[Reference(s, "data_id", "records") for s in
     ("versions", "artifact_sources", "query_sources", "memory_members", "case_members", "entity_mentions", "entity_edges", "normalized_records", "share_links")]),
    (Mark("artifacts", "artifact_sources", "artifact_id", "none_left", "stale_reason is null", (("stale_reason", "'source_deleted'"),)),
     Mark("queries", "query_sources", "query_id", "any_lost", "true", (("answer", "null"),)),
     Mark("entity_facts", "entity_edges", "fact_id", "none_left", "basis = 'derived' and retracted_at is null", (("retracted_at", f"timestamp_ntz '{AT}'"), ("retracted_reason", "'last evidence erased'")))),
    ("text",),
)

_WORLD_SQL = f"""{ITEMS_SQL}, gone AS (SELECT data_id FROM items WHERE project_id = (SELECT min(project_id) FROM items) AND data_id % 11 <> 0), m AS (SELECT count(*) AS n FROM documents),
chunks AS (SELECT data_id * 10 + k AS id, data_id FROM items, range(0, 3) t(k) WHERE n_chars > k * 1000),
embeddings_ AS (SELECT vec_id AS id, vec_id * 10 AS chunk_id FROM embeddings),
versions AS (SELECT doc_id AS id, doc_id AS data_id FROM labels),
artifact_sources AS (SELECT doc_id AS id, doc_id AS data_id, doc_id // 2 AS artifact_id FROM documents),
query_sources AS (SELECT event_id AS id, event_id % n AS data_id, user_id AS query_id FROM events, m),
memory_members AS (SELECT conv_id * 1000 + turn AS id, (conv_id * 7 + turn) % n AS data_id FROM conversations, m),
case_members AS (SELECT c_custkey AS id, c_custkey % n AS data_id FROM customer, m),
entity_mentions AS (SELECT s_suppkey AS id, s_suppkey * 3 % n AS data_id FROM supplier, m),
entity_edges AS (SELECT o_orderkey AS id, o_orderkey // 15 AS data_id, o_orderkey // 30 AS fact_id FROM orders),
normalized_records AS (SELECT p_partkey AS id, p_partkey % n AS data_id FROM part, m),
share_links AS (SELECT page_id AS id, page_id % n AS data_id FROM pages, m),
refs AS (SELECT 'chunks' AS store, id, data_id FROM chunks UNION ALL SELECT 'versions', id, data_id FROM versions UNION ALL SELECT 'artifact_sources', id, data_id FROM artifact_sources UNION ALL SELECT 'query_sources', id, data_id FROM query_sources
  UNION ALL SELECT 'memory_members', id, data_id FROM memory_members UNION ALL SELECT 'case_members', id, data_id FROM case_members UNION ALL SELECT 'entity_mentions', id, data_id FROM entity_mentions
  UNION ALL SELECT 'entity_edges', id, data_id FROM entity_edges UNION ALL SELECT 'normalized_records', id, data_id FROM normalized_records UNION ALL SELECT 'share_links', id, data_id FROM share_links
  UNION ALL SELECT 'embeddings', e.id, c.data_id FROM embeddings_ e LEFT JOIN chunks c ON c.id = e.chunk_id)"""


def _stores(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    i, c = items(spark, sf_dir), F.col
    n = t("documents").count()
    none = F.lit(None)
    edges = t("orders").select(c("o_orderkey").alias("edge_id"), F.expr("o_orderkey div 15").alias("data_id"), F.expr("o_orderkey div 30").alias("fact_id"))
    return {
        "records": i.select("data_id", "project_id", "text", none.cast("timestamp_ntz").alias("purged_at")),
        "chunks": i.select("data_id", "n_chars", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("k")).where(c("n_chars") > c("k") * 1000).select((c("data_id") * 10 + c("k")).alias("chunk_id"), "data_id"),
        "embeddings": t("embeddings").select("vec_id", (c("vec_id") * 10).alias("chunk_id")),
        "versions": t("labels").select(c("doc_id").alias("version_id"), c("doc_id").alias("data_id")),
        "artifact_sources": t("documents").select(c("doc_id").alias("source_id"), c("doc_id").alias("data_id"), F.expr("doc_id div 2").alias("artifact_id")),
        "artifacts": t("documents").select(F.expr("doc_id div 2").alias("artifact_id")).distinct().withColumn("stale_reason", F.when(c("artifact_id") % 10 == 0, "newer_model")),
        "query_sources": t("events").select(c("event_id").alias("seen_id"), (c("event_id") % n).alias("data_id"), c("user_id").alias("query_id")),
        "queries": t("events").select(c("user_id").alias("query_id")).distinct().withColumn("answer", F.lit("said")),
        "memory_members": t("conversations").select((c("conv_id") * 1000 + c("turn")).alias("member_id"), ((c("conv_id") * 7 + c("turn")) % n).alias("data_id")),
        "case_members": t("customer").select(c("c_custkey").alias("member_id"), (c("c_custkey") % n).alias("data_id")),
        "entity_mentions": t("supplier").select(c("s_suppkey").alias("mention_id"), (c("s_suppkey") * 3 % n).alias("data_id")),
        "entity_edges": edges,
        "entity_facts": edges.groupBy("fact_id").agg(F.count("*").alias("edges")).select("fact_id", F.when(c("fact_id") % 5 == 0, "asserted").otherwise("derived").alias("basis"), none.cast("timestamp_ntz").alias("retracted_at"), none.cast("string").alias("retracted_reason")),
        "normalized_records": t("part").select(c("p_partkey").alias("norm_id"), (c("p_partkey") % n).alias("data_id")),
        "share_links": t("pages").select(c("page_id").alias("link_id"), (c("page_id") % n).alias("data_id")),
    }


def _gone(spark, sf_dir):
    rows = items(spark, sf_dir)
    return rows.join(rows.agg(F.min("project_id").alias("project_id")), "project_id", "left_semi").where("data_id % 11 <> 0").select("data_id")


@query(f"""WITH {_WORLD_SQL},
left_sources AS (SELECT DISTINCT artifact_id FROM artifact_sources WHERE data_id NOT IN (SELECT data_id FROM gone)), left_edges AS (SELECT DISTINCT fact_id FROM entity_edges WHERE data_id NOT IN (SELECT data_id FROM gone))
SELECT store, count_if(data_id IN (SELECT data_id FROM gone)) AS removed, count(*) - count_if(data_id IN (SELECT data_id FROM gone)) AS kept, 0 AS changed FROM refs GROUP BY store
UNION ALL SELECT 'records', 0, count(*), count_if(data_id IN (SELECT data_id FROM gone)) FROM items
UNION ALL SELECT 'artifacts', 0, count(*), count_if(artifact_id NOT IN (SELECT artifact_id FROM left_sources) AND artifact_id % 10 <> 0) FROM (SELECT DISTINCT artifact_id FROM artifact_sources)
UNION ALL SELECT 'queries', 0, count(*), count_if(query_id IN (SELECT query_id FROM query_sources WHERE data_id IN (SELECT data_id FROM gone))) FROM (SELECT DISTINCT query_id FROM query_sources)
UNION ALL SELECT 'entity_facts', 0, count(*), count_if(fact_id % 5 <> 0 AND fact_id NOT IN (SELECT fact_id FROM left_edges)) FROM (SELECT DISTINCT fact_id FROM entity_edges)""")
def purge_stores(spark, sf_dir):
    """What the erasure of a project (legal holds left out) removes, keeps and changes in each of fourteen stores beside the records."""
    stores = {n: written(s) for n, s in _stores(spark, sf_dir).items()}
    after = purge(stores, REGISTRY, _gone(spark, sf_dir), AT)
    changed = {"records": "purged_at is not null", "artifacts": "stale_reason = 'source_deleted'", "queries": "answer is null", "entity_facts": "retracted_at is not null"}
    rows = None
    for name, store in after.items():
        one = store.agg(F.count("*").alias("kept"), F.count_if(F.expr(changed.get(name, "false"))).cast("int").alias("changed"))
        one = one.crossJoin(stores[name].agg(F.count("*").alias("was"))).select(F.lit(name).alias("store"), (F.col("was") - F.col("kept")).alias("removed"), "kept", "changed")
        rows = one if rows is None else rows.union(one)
    return rows


@query(f"""WITH {_WORLD_SQL}, left_edges AS (SELECT DISTINCT fact_id FROM entity_edges), n AS (SELECT store, CASE WHEN store IN ('share_links', 'entity_mentions') THEN count_if(data_id IN (SELECT data_id FROM gone))
    WHEN store = 'embeddings' THEN count_if(data_id IS NULL) ELSE 0 END AS remaining FROM refs GROUP BY store
  UNION ALL SELECT 'records', 0 UNION ALL SELECT 'artifacts', 0 UNION ALL SELECT 'entity_facts', 0)
SELECT store, remaining::BIGINT AS remaining, remaining = 0 AS complete FROM n""")
def purge_proof(spark, sf_dir):
    """The proof after a purge whose registry forgot two stores; embeddings without a chunk were dangling before it."""
    stores = {n: written(s) for n, s in _stores(spark, sf_dir).items()}
    gone = written(_gone(spark, sf_dir))
    forgetful = Registry(REGISTRY.root, REGISTRY.keys, tuple(r for r in REGISTRY.references if r.child not in ("share_links", "entity_mentions")), REGISTRY.marks, REGISTRY.cleared)
    return proof(purge(stores, forgetful, gone, AT), REGISTRY, gone)
