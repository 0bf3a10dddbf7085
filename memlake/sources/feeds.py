"""What arrives from outside: webhook deliveries, link graphs, recorded indexes, cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.selectors import dig
from memlake.operators.written import written


def parse_time(value: Column) -> Column:
    """Seconds since 1970 of an epoch in seconds or milliseconds, or of an ISO time; null if it is neither."""
    number = value.try_cast("double")
    iso = F.unix_timestamp(F.try_to_timestamp(value))
    return F.when(number.isNotNull(), F.floor(F.when(number > 1e11, number / 1000).otherwise(number))).otherwise(iso).cast("long")


def delivered_items(deliveries: DataFrame, items_path: str, id_path: str, text_path: str, time_path: str) -> DataFrame:
    """deliveries: delivery_id, received, payload (JSON) -> delivery_id, item_id, body, occurred. A delivery that is repeated counts
    once, as first received; an item without an id is named by a hash of itself."""
    first = deliveries.groupBy("delivery_id").agg(F.min_by("payload", "received").alias("payload"))
    item = first.select("delivery_id", F.explode(F.from_json(F.get_json_object("payload", f"$.{items_path}"), "array<string>")).alias("item"))
    named = F.coalesce(dig(F.col("item"), id_path), F.substring(F.sha2("item", 256), 1, 24))
    return item.select("delivery_id", named.alias("item_id"), dig(F.col("item"), text_path).alias("body"), parse_time(dig(F.col("item"), time_path)).alias("occurred"))


def rebuilt_text(postings: DataFrame) -> DataFrame:
    """data_id, word, positions -> data_id, text: the words at their positions; of two at one position the greater."""
    placed = postings.select("data_id", "word", F.explode("positions").alias("at")).groupBy("data_id", "at").agg(F.max("word").alias("word"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"])
    return placed.groupBy("data_id").agg(F.array_join(ordered, " ").alias("text"))


def traverse(links: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """links: source, target; roots: url. Every address reachable in ``depth`` steps, at its least step."""
    met = roots.select("url", F.lit(0).alias("step")).distinct()
    frontier = met
    edges = written(links.select(F.col("source").alias("url"), "target").distinct())
    for step in range(1, depth + 1):
        fresh = frontier.join(edges, "url").select(F.col("target").alias("url")).distinct().join(met.select("url"), "url", "left_anti")
        frontier = written(fresh.withColumn("step", F.lit(step)))
        met = met.union(frontier)
    return met


def run_watermarks(runs: DataFrame) -> DataFrame:
    """crawler, run, version, ok (one row per item) -> crawler, run, status, watermark: the greatest version of all fully successful
    runs so far; a partial run leaves it where it was."""
    each = runs.groupBy("crawler", "run").agg(F.max("version").alias("version"), F.bool_and("ok").alias("whole"), F.bool_or("ok").alias("some"))
    so_far = Window.partitionBy("crawler").orderBy("run")
    status = F.when(F.col("whole"), "ok").when(F.col("some"), "partial").otherwise("failed")
    return each.select("crawler", "run", status.alias("status"), F.max(F.when(F.col("whole"), F.col("version"))).over(so_far).alias("watermark"))


def fetch_refusal(url: Column) -> Column:
    """Why an address may not be fetched: scheme, a host without a name, or a private network; null if it may."""
    scheme, host = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    private = host.rlike(r"^(?:localhost|0\.|10\.|127\.|169\.254\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.)") | host.rlike(r"\.(?:local|internal)$")
    return F.when(~scheme.isin("http", "https"), "scheme").when(host == "", "host").when(private, "private")


def video_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"(?:youtu\.be/|youtube\.com/(?:watch\?(?:[^#]*&)?v=|embed/|shorts/))([A-Za-z0-9_-]{11})", 1), F.lit(""))


def repository(url: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_extract(url, r"github\.com[/:]([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+)", 1), r"\.git$", ""), F.lit(""))
