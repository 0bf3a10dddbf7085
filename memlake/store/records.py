"""The write path: admission, upsert by natural key into a versioned table, and an append-only history of revisions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.operators.written import written
from memlake.store.versions import Versions

#: Most items and bytes of a write, and most stored records that may wait for enrichment.
ITEMS, BYTES, BACKLOG = 500, 32 << 20, 10_000

RECORDS = "project_id string, producer_id string, external_id string, data_id string, text string, mime_type string, checksum string, event_time timestamp_ntz, access_level string, tags array<string>, state string, deleted_at timestamp_ntz, deletion_reason string, revision int, updated_at timestamp_ntz"
REVISIONS = "data_id string, revision int, source string, checksum string, chars int, changed boolean, at timestamp_ntz"
KEY = ("project_id", "producer_id", "external_id")
PAYLOAD = ("text", "mime_type", "event_time", "access_level", "tags")


def admitted(items: DataFrame, waiting: DataFrame | None = None) -> DataFrame:
    """items: write_id, index, text, ... with ``refused`` beside them: a write is refused whole if it has more than ``ITEMS`` items or
    ``BYTES`` bytes of text (a producer sends smaller writes), and when ``BACKLOG`` of the records in ``waiting`` already wait (it comes back
    later; None: nothing is held back); an item without a key is refused alone."""
    size = items.groupBy("write_id").agg(F.count("*").alias("n"), F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes"))
    backlog = F.lit(0) if waiting is None else F.lit(waiting.count())
    whole = F.when(F.col("n") > ITEMS, "too_many_items").when(F.col("bytes") > BYTES, "too_large").when(backlog >= BACKLOG, "backlog_full")
    keyless = F.when(F.greatest(*[F.col(k).isNull() for k in KEY]), "no_key")
    return items.join(size, "write_id").withColumn("refused", F.coalesce(whole, keyless)).drop("n", "bytes")


@dataclass
class Records:
    """Stored records and their revisions under one folder."""

    spark: SparkSession
    path: str
    buckets: int = 16

    def __post_init__(self) -> None:
        self.table = Versions(self.spark, f"{self.path}/records", RECORDS, KEY, self.buckets)
        self.history = Versions(self.spark, f"{self.path}/revisions", REVISIONS, ("data_id",), self.buckets)

    def write(self, items: DataFrame, at: str, live: bool = True) -> DataFrame:
        """items: write_id, index, the key and the payload -> write_id, index, status (created, updated, refused), data_id, error. ``live``: the
        writes of producers, who are sent away while too many records wait for enrichment and come back later; a batch that nobody will send
        again (a load, a replay) is taken whole, whatever waits.

        Of several items with one key the last of the write counts, the earlier ones are updates of the same record. A record that exists
        keeps its data_id; its payload is overwritten, its state starts again, and a tombstone is cleared, as somebody supplied the content
        again. Every write adds a revision, numbered from the history, that says whether the content changed. Writing a batch again
        changes no content and adds no second record."""
        checked = written(admitted(items, self.table.read().where("state = 'stored' and deleted_at is null") if live else None))
        taken = checked.where("refused is null")
        place = Window.partitionBy(*KEY).orderBy(F.desc("write_id"), F.desc("index"))
        last = taken.withColumn("place", F.row_number().over(place)).where("place = 1")
        digest = F.sha2(F.coalesce("text", F.lit("")), 256)
        now = F.lit(at).cast("timestamp_ntz")
        prior = written(self.table.read().select(*KEY, F.col("data_id").alias("known")).join(last.select(*KEY), list(KEY), "left_semi"))
        batch = written(last.select(*KEY, *PAYLOAD, digest.alias("checksum"), F.sha2(F.to_json(F.struct(*KEY)), 256).alias("fresh")))

        def merged(both: DataFrame) -> DataFrame:
            revision = F.coalesce(F.col("old.revision"), F.lit(0)) + 1
            return both.select(
                *KEY, F.coalesce("old.data_id", "fresh").alias("data_id"), *PAYLOAD, "checksum", F.lit("stored").alias("state"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"),
                F.lit(None).cast("string").alias("deletion_reason"), revision.alias("revision"), now.alias("updated_at"))

        self.table.upsert(batch, merged)
        current = self.table.read().join(batch.select(*KEY), list(KEY), "left_semi")
        self.revise(current.select("data_id", "checksum", F.length(F.coalesce("text", F.lit(""))).alias("chars")), "write", at)
        named = taken.join(prior, list(KEY), "left").select("write_id", "index", F.when(F.col("known").isNull(), "created").otherwise("updated").alias("status"), F.coalesce("known", F.sha2(F.to_json(F.struct(*KEY)), 256)).alias("data_id"), F.lit(None).cast("string").alias("error"))
        out = checked.where("refused is not null").select("write_id", "index", F.lit("refused").alias("status"), F.lit(None).cast("string").alias("data_id"), F.col("refused").alias("error"))
        return written(named.unionByName(out))

    def revise(self, contents: DataFrame, source: str, at: str) -> int:
        """contents: data_id, checksum, chars. Appends revision max + 1 to each record's history; ``changed`` where the content differs from the one before."""
        new = written(contents)

        def rewrite(stored: DataFrame) -> DataFrame:
            last = stored.groupBy("data_id").agg(F.max("revision").alias("top"), F.max_by("checksum", "revision").alias("before"))
            met = new.join(last, "data_id", "left")
            rows = met.select("data_id", (F.coalesce("top", F.lit(0)) + 1).alias("revision"), F.lit(source).alias("source"), "checksum", "chars", (~F.col("checksum").eqNullSafe(F.col("before"))).alias("changed"), F.lit(at).cast("timestamp_ntz").alias("at"))
            return stored.unionByName(rows)

        return self.history.change(new, rewrite)

    def erase(self, gone: DataFrame, reason: str, at: str) -> int:
        """gone: the keys of records. Content goes, a tombstone stays."""
        now = F.lit(at).cast("timestamp_ntz")
        empty = F.lit(None).cast("string")
        return self.table.update_from(gone.select(*KEY).distinct(), text=empty, checksum=empty, tags=F.array().cast("array<string>"), state=F.lit("erased"), deleted_at=now, deletion_reason=F.lit(reason), updated_at=now)

    def enriched(self, done: DataFrame, at: str) -> int:
        """done: the keys and ``state`` of records that a later stage has handled; erased ones stay erased."""
        return self.table.update_from(done.select(*KEY, "state").distinct(), state=F.when(F.col("deleted_at").isNull(), F.col("new.state")).otherwise(F.col("state")), updated_at=F.lit(at).cast("timestamp_ntz"))
