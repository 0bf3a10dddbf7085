"""The driver's tables seen as the engine's model: records with owners and access levels, memories, claims, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.operators.access import LEVELS, Principal
from memlake.plans.tables import table

READER = Principal("u1", "en", ("g0",))

#: The same view in DuckDB, for the checks.
ITEMS_SQL = """items AS (
  SELECT doc_id AS data_id, source AS project_id, lang AS org_id, 'u' || (doc_id % 7) AS owner_id,
    ['private','restricted','shared','org','public'][(doc_id % 5 + 1)::INT] AS access_level,
    ['user:u' || (doc_id % 3), 'group:g' || (doc_id % 2)] AS shared_with, doc_id % 17 = 0 AS deleted,
    TIMESTAMP '2024-01-01' + to_hours(doc_id::INT) AS event_time, text, n_chars FROM documents),
seen AS (SELECT * FROM items WHERE org_id = 'en' AND NOT deleted AND (access_level IN ('org','public')
    OR (access_level = 'private' AND owner_id = 'u1')
    OR (access_level = 'shared' AND (owner_id = 'u1' OR list_has_any(shared_with, ['user:u1','org:en','public','group:g0'])))
    OR (access_level = 'restricted' AND list_has_any(shared_with, ['user:u1','org:en','public','group:g0']))))"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("data_id"),
        F.col("source").alias("project_id"),
        F.col("lang").alias("org_id"),
        F.concat(F.lit("u"), F.col("doc_id") % 7).alias("owner_id"),
        F.element_at(F.array(*[F.lit(x) for x in LEVELS]), (F.col("doc_id") % 5 + 1).cast("int")).alias("access_level"),
        F.array(F.concat(F.lit("user:u"), F.col("doc_id") % 3), F.concat(F.lit("group:g"), F.col("doc_id") % 2)).alias("shared_with"),
        (F.col("doc_id") % 17 == 0).alias("deleted"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("doc_id").cast("int"))).alias("event_time"),
        "text",
        "n_chars",
    )


#: Claims: an order is evidence that its customer ``uses`` a priority from its date on; orders arrive by key.
CLAIMS_SQL = "claims AS (SELECT o_orderkey AS fact_id, o_custkey AS subject, o_orderpriority AS object, o_orderdate AS valid_from FROM orders)"


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("fact_id"), F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("object"), F.col("o_orderdate").alias("valid_from"))


#: Memories: a conversation is a memory, a turn a member added that many hours after the first of the year.
MEMBERS_SQL = """members AS (SELECT 'm' || conv_id AS memory_id, conv_id % 7 * 1000 + turn AS data_id, turn AS seq,
    TIMESTAMP '2024-01-01' + to_hours((conv_id % 24 + turn)::INT) AS added_at,
    CASE conv_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 3600 ELSE 86400 END AS ttl, role, text FROM conversations)"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.concat(F.lit("m"), "conv_id").alias("memory_id"),
        (F.col("conv_id") % 7 * 1000 + F.col("turn")).alias("data_id"),
        F.col("turn").alias("seq"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("conv_id") % 24 + F.col("turn")).cast("int"))).alias("added_at"),
        F.when(F.col("conv_id") % 3 == 1, 3600).when(F.col("conv_id") % 3 == 2, 86400).alias("ttl"),
        "role",
        "text",
    )
