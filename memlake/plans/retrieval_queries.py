"""Hybrid retrieval queries."""

from pyspark.sql import functions as F

from memlake.functions.chunking import chunks, hash_embed
from memlake.operators.access import visible
from memlake.operators.retrieval import exclusions, fuse, lexical_arm, over_fetch, passages, terms, vector_arm
from memlake.operators.vector_index import write_index
from memlake.operators.written import new_path
from memlake.plans.analytics_queries import _STATE_SQL, _stated
from memlake.plans.lens import ITEMS_SQL, READER, items
from memlake.plans.registry import query, table

LIMIT = 10

_VECTOR_SQL = """probe AS (SELECT embedding::DOUBLE[] AS q, label % 2 AS model FROM embeddings WHERE vec_id = 0),
near AS (SELECT vec_id AS data_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, probe WHERE label % 2 = model AND vec_id IN (SELECT data_id FROM seen)),
vector AS (SELECT *, row_number() OVER (ORDER BY score DESC, data_id) AS rank FROM near QUALIFY rank <= 40)"""
_LEXICAL_SQL = """asked AS (SELECT list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark ORDER BY item_id LIMIT 1),
overlap AS (SELECT data_id, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), w))::DOUBLE AS score FROM seen, asked),
lexical AS (SELECT *, row_number() OVER (ORDER BY score DESC, data_id) AS rank FROM overlap WHERE score > 0 QUALIFY rank <= 40)"""
_FUSED_SQL = """fused AS (SELECT *, row_number() OVER (ORDER BY score DESC, data_id) AS rank FROM (
  SELECT data_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, string_agg(arm, ',' ORDER BY arm) AS arms FROM (
    SELECT data_id, rank, 'vector' AS arm FROM vector UNION ALL SELECT data_id, rank, 'lexical' FROM lexical) GROUP BY 1) QUALIFY rank <= 25)"""
_ALL_SQL = f"{ITEMS_SQL}, {_VECTOR_SQL}, {_LEXICAL_SQL}, {_FUSED_SQL}"


def _vector(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    probe = e.where("vec_id = 0").select("embedding", (F.col("label") % 2).alias("model")).first()
    own = e.where(F.col("label") % 2 == probe.model).select(F.col("vec_id").alias("data_id"), F.col("embedding").alias("vector"))
    allowed = items(spark, sf_dir).where(visible(READER)).select("data_id")
    return vector_arm(own.join(allowed, "data_id", "left_semi"), probe.embedding, over_fetch(LIMIT))


def _lexical(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").orderBy("item_id").limit(1).select(terms(F.col("text")).alias("w")).first().w
    return lexical_arm(items(spark, sf_dir).where(visible(READER)), words, over_fetch(LIMIT))


def _fused(spark, sf_dir):
    return fuse({"vector": _vector(spark, sf_dir), "lexical": _lexical(spark, sf_dir)}, LIMIT)


@query(f"WITH {ITEMS_SQL}, {_VECTOR_SQL} SELECT data_id, score, rank::INT AS rank FROM vector")
def vector_topk(spark, sf_dir):
    return _vector(spark, sf_dir)


@query(f"WITH {ITEMS_SQL}, {_LEXICAL_SQL} SELECT data_id, score, rank::INT AS rank FROM lexical")
def lexical_topk(spark, sf_dir):
    return _lexical(spark, sf_dir)


@query(f"WITH {_ALL_SQL} SELECT data_id, score, arms, rank::INT AS rank FROM fused WHERE rank <= 10")
def rrf_fusion(spark, sf_dir):
    return _fused(spark, sf_dir).where(F.col("rank") <= LIMIT)


@query(f"""WITH {_ALL_SQL}, {_STATE_SQL} SELECT data_id, 'threshold' AS reason FROM fused WHERE rank > 10
  UNION ALL SELECT * FROM (SELECT data_id, 'not_yet_enriched' FROM stated WHERE state = 'stored' ORDER BY data_id LIMIT 25)""")
def retrieval_trace(spark, sf_dir):
    return exclusions(_fused(spark, sf_dir), _stated(spark, sf_dir).where("state = 'stored'"), LIMIT)


@query(f"""WITH {_ALL_SQL} SELECT rank::INT AS rank, data_id, left(trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g')), 280) || ' [' || rank || ']' AS passage
  FROM fused JOIN seen USING (data_id) WHERE rank <= 3""")
def extractive_answer(spark, sf_dir):
    return passages(_fused(spark, sf_dir), items(spark, sf_dir).where(visible(READER)))


@query("""SELECT doc_id AS data_id, k AS ordinal, (k * 1050)::INT AS span_start, least(k * 1050 + 1200, length(text))::INT AS span_end, substring(text, (k * 1050 + 1)::BIGINT, 1200) AS chunk
  FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(0, ceil((length(text) - 1200) / 1050.0))::BIGINT))::INT AS k FROM documents)
  WHERE regexp_matches(substring(text, (k * 1050 + 1)::BIGINT, 1200), '\\S')""")
def chunk_spans(spark, sf_dir):
    return chunks(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("data_id"), "text"))


@query()
def hash_embeddings(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("data_id"), hash_embed(F.col("text")).alias("embedding"))


@query("SELECT label % 2 AS model_id, len(embedding) AS dim, count(*) AS vectors, count(DISTINCT label) AS labels FROM embeddings GROUP BY 1, 2")
def vector_spaces(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy((F.col("label") % 2).alias("model_id"), F.size("embedding").alias("dim")).agg(F.count("*").alias("vectors"), F.countDistinct("label").alias("labels"))


@query("SELECT label % 2 AS model_id, count(DISTINCT len(embedding)) AS dims FROM embeddings GROUP BY 1 HAVING count(DISTINCT len(embedding)) > 1")
def dimension_guard(spark, sf_dir):
    """Must be empty: one vector length for each model."""
    return table(spark, sf_dir, "embeddings").groupBy((F.col("label") % 2).alias("model_id")).agg(F.countDistinct(F.size("embedding")).alias("dims")).where("dims > 1")


def _indexed(spark, sf_dir):
    """The probe, its model's index over all vectors, and the records that the reader may see."""
    e = table(spark, sf_dir, "embeddings")
    probe = e.where("vec_id = 0").select("embedding", (F.col("label") % 2).alias("model")).first()
    own = e.where(F.col("label") % 2 == probe.model).select(F.col("vec_id").alias("data_id"), F.col("embedding").alias("vector"))
    return probe.embedding, own, write_index(own, new_path(spark, "vectors"))


@query(f"WITH {ITEMS_SQL}, {_VECTOR_SQL} SELECT data_id, score, rank::INT AS rank FROM vector")
def vector_topk_all_cells(spark, sf_dir):
    """The index told to read all its cells: the exact form."""
    probe, _, index = _indexed(spark, sf_dir)
    return index.search(probe, over_fetch(LIMIT), 1.0, items(spark, sf_dir).where(visible(READER)).select("data_id"))


@query()
def vector_index_probe(spark, sf_dir):
    """Health of the index: for every hundredth vector, how many of its ten nearest are in the quarter of the cells that a search reads."""
    _, own, index = _indexed(spark, sf_dir)
    return index.recall(own.where("data_id % 100 = 0").select(F.col("data_id").alias("probe_id"), "vector"))
