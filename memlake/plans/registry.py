"""All queries of the reference's own operators, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from memlake.plans.tables import table  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the DuckDB SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


from memlake.plans import access_queries, analytics_queries, container_queries, entity_queries, erasure_queries, fact_queries, graph_queries, ingest_queries, lifecycle_queries, passage_queries, reading_queries, retrieval_queries, seen_graph_queries, source_queries, speech_queries, state_queries, store_queries, stream_queries, text_queries, upkeep_queries, watch_queries  # noqa: E402, F401
