"""Queries opN_<name> over the corpus tables, each its operator with production parameters, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm.best_fit import best_fit
from memlake.llm.chosen_path import chosen_path_join
from memlake.llm.collocations import collocations
from memlake.llm.divergence import source_divergence
from memlake.llm.impact_index import impact_topk
from memlake.llm.language_mixture import language_mixture
from memlake.llm.license_index import license_scan
from memlake.llm.main_text import main_text
from memlake.llm.mixing import mix
from memlake.llm.multi_index import multi_index_links
from memlake.llm.partial_matching import partial_matching
from memlake.llm.pii_labelers import pii_report
from memlake.llm.toxicity_fm import toxicity

#: Target weights of the mixing query, by domain and language; sources of a language weigh the same.
MIX_WEIGHTS = {"domain0": 0.5, "domain1": 0.3, "domain2": 0.2, "en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.6, 4, 1


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_domain(docs: DataFrame) -> DataFrame:
    """The tables have no domain: three are made of the sources."""
    return docs.withColumn("domain", F.concat(F.lit("domain"), F.crc32(F.coalesce("source", F.lit("null"))) % 3))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_domain(_table(spark, sf_dir, "documents"))
    return mix(docs, ["domain", "lang", "source"], MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED).drop("unit")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixture = F.transform("mixture", lambda m: F.concat_ws("=", m["lang"], F.round(m["share"], 3).cast("string")))
    return language_mixture(_table(spark, sf_dir, "documents")).withColumn("mixture", F.array_join(mixture, ","))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path_join(_table(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(_table(spark, sf_dir, "documents"))


def op8_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op9_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index_links(_table(spark, sf_dir, "embeddings"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_topk(_table(spark, sf_dir, "embeddings"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op12_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partial_matching(_table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_mixing, op3_language, op4_minhash, op5_html, op6_toxicity, op7_packing, op8_license, op9_embedding, op10_topk, op11_collocations, op12_ppm, op13_divergence)}


_COMPONENTS = """reach(id, other) AS (
  SELECT id, id FROM ids UNION
  SELECT r.id, CASE WHEN l.a = r.other THEN l.b ELSE l.a END FROM reach r JOIN links l ON r.other IN (l.a, l.b)),
comp AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""

OP4_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
ids AS (
  SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM words),
each AS (SELECT id, unnest(s) AS x FROM ids),
common AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM each a JOIN each b ON a.x = b.x AND a.id < b.id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN ids p ON p.id = a JOIN ids q ON q.id = b WHERE 100 * c >= 85 * (len(p.s) + len(q.s) - c)),
{_COMPONENTS}
SELECT id AS doc_id, len(s)::BIGINT AS n_shingles, component_id, id = component_id AS kept FROM ids JOIN comp USING (id)"""

OP9_SQL = f"""
WITH RECURSIVE ids AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings),
links AS (SELECT a.id AS a, b.id AS b FROM ids a JOIN ids b ON a.label = b.label AND a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
{_COMPONENTS}
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE ids.id IN (a, b)) AS n_links, component_id, id = component_id AS kept FROM ids JOIN comp USING (id)"""

OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY rank <= 10"""

OP11_SQL = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
t AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 6) s(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS s, count(*)::HUGEINT AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, phrase, a, s, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
v AS (SELECT c.lang, c.phrase, c.a, cut, l.a AS l, r.a AS r, n, (1000 * c.a * n) // (l.a * r.a) AS score FROM c JOIN t USING (lang)
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.s[1:cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.s[cut + 1:], ' ')),
m AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.lang = m.lang AND f.a >= m.a AND f.phrase <> m.phrase AND contains(' ' || f.phrase || ' ', ' ' || m.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::INT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM o QUALIFY rank <= 2000"""

OP13_SQL = """
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
w AS (SELECT id, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS total FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM k GROUP BY lang),
gr AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM c GROUP BY ALL),
p AS (SELECT k.lang, source, term, coalesce(c.n, 0) AS count, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (coalesce(n.n, 0) + v) AS p, 1 + (1000000000 * (total + 1)) // (v.n + v) AS q
  FROM k JOIN v USING (lang) JOIN gr USING (lang) LEFT JOIN n USING (lang, source) LEFT JOIN c USING (lang, source, term)),
t AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE count > 0 AND p > q),
o AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT gr.lang, gr.source, 'pair' AS part, g.source AS item, coalesce(value, 0) AS value FROM gr JOIN gr g ON gr.lang = g.lang AND gr.source <> g.source LEFT JOIN o ON o.lang = gr.lang AND o.source = gr.source AND o.item = g.source),
u AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM t UNION ALL SELECT * FROM r))
SELECT lang, source, part, item, value::BIGINT AS value, rank FROM u WHERE part = 'pair' OR rank <= 200"""


def oracle_sql() -> dict[str, str]:
    return {"op4_minhash": OP4_SQL, "op9_embedding": OP9_SQL, "op10_topk": OP10_SQL, "op11_collocations": OP11_SQL, "op13_divergence": OP13_SQL}
