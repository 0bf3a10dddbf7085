"""Entities from mentions: joined by shared identifiers, else by type and normal form of the name, and through merges that can be undone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.names import normalize_identifier, normalize_name
from memlake.operators.components import components
from memlake.operators.written import written

#: The types of entities.
TYPES = ("person", "organization", "location", "product", "event", "topic", "other")


def resolve(candidates: DataFrame) -> DataFrame:
    """candidates: data_id, seq, name, type, identifier -> mentions: data_id, surface, type, entity, resolved_by, seq.

    Names of one type and normal form are one entity, and a shared identifier joins entities whatever their names and types, however long the
    chain; so what arrives first makes no difference. An entity is named by the least ``type:normal form`` in it. resolved_by: ``new`` for
    the first mention of an entity (by data_id, seq), ``identifier`` where the mention has an identifier that others of the entity have too,
    else ``exact_name``. A record's mentions of one name and type are one piece of evidence, the first. Nameless ones and unknown types go;
    a null type is ``other``."""
    kind = F.coalesce("type", F.lit("other"))
    plain = candidates.select("data_id", "seq", F.trim("name").alias("surface"), kind.alias("type"), normalize_name(F.col("name")).alias("normal"), normalize_identifier(F.col("identifier")).alias("identifier"))
    named = plain.where((F.length("normal") > 0) & F.col("type").isin(*TYPES)).withColumn("key", F.concat("type", F.lit(":"), "normal"))
    first = Window.partitionBy("data_id", "key").orderBy("seq", "surface", "identifier")
    named = written(named.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n"))
    told = named.where("length(identifier) > 0")
    joined = components(told.select(F.col("key").alias("a"), F.concat(F.lit("\x7f"), "identifier").alias("b")).distinct())
    shared = told.groupBy("identifier").agg((F.count("*") > 1).alias("shared"))
    met = named.join(joined.withColumnRenamed("id", "key"), "key", "left").withColumn("entity", F.coalesce("label", "key")).join(shared, "identifier", "left")
    opens = met.groupBy("entity").agg(F.min(F.struct("data_id", "seq", "key")).alias("opens"))
    why = F.when(F.struct("data_id", "seq", "key") == F.col("opens"), "new").when(F.coalesce("shared", F.lit(False)), "identifier").otherwise("exact_name")
    return met.join(opens, "entity").select("data_id", "seq", "surface", "type", "entity", why.alias("resolved_by"))


def survivors(merges: DataFrame) -> DataFrame:
    """merges: merge_id, source, target, undone -> source, entity: where each merged entity has ended up, merges of merged ones followed to
    their end. A merge into itself, or one that would close a circle, leads nowhere and is left out."""
    ends = written(merges.where("not undone and source <> target").groupBy("source").agg(F.max_by("target", "merge_id").alias("entity")))
    while True:
        step = ends.join(ends.toDF("entity", "further"), "entity", "left").select("source", F.col("entity").alias("old"), F.coalesce("further", "entity").alias("entity"))
        step = written(step.where("entity <> source"))
        ends = step.select("source", "entity")
        if step.where("old <> entity").isEmpty():
            return ends


def merged(mentions: DataFrame, merges: DataFrame) -> DataFrame:
    """The mentions by the entities that survive; ``base`` keeps what a mention was resolved to, so that an undone merge gives back its
    mentions, those that came after it under the source's name included, and no others."""
    return mentions.withColumnRenamed("entity", "base").join(survivors(merges).withColumnRenamed("source", "base"), "base", "left").withColumn("entity", F.coalesce("entity", "base"))


def entities(mentions: DataFrame) -> DataFrame:
    """entity, display_name (the fullest surface, the least of equals), type (of the entity's own name), mentions, records."""
    own = F.split("entity", ":", 2)[0]
    g = mentions.groupBy("entity").agg(F.min(F.struct((-F.length("surface")).alias("short"), "surface")).alias("best"), F.count("*").alias("mentions"), F.countDistinct("data_id").alias("records"))
    return g.select("entity", F.col("best.surface").alias("display_name"), own.alias("type"), "mentions", "records")
