"""Claims seen through their evidence: who may read one, on which clocks it holds, under which lens or from which source it was drawn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.operators.access import Principal, visible
from memlake.operators.graph import holds_at, neighbourhood


def readable(evidence: DataFrame, records: DataFrame, who: Principal) -> DataFrame:
    """evidence: fact_id, data_id, ...; the rows whose record ``who`` may see."""
    return evidence.join(records.where(visible(who)).select("data_id"), "data_id", "left_semi")


def visible_facts(facts: DataFrame, seen: DataFrame, who: Principal) -> DataFrame:
    """Facts that ``who`` may see, with the number of records that they may read for each. A derived fact has no access level of its own: it is
    seen where some of its evidence is, so it goes when the last such record goes. An asserted fact is seen by its own level.

    seen: what ``readable`` gives. One aggregate of the evidence and one join, whatever the kinds of facts."""
    backed = seen.groupBy("fact_id").agg(F.countDistinct("data_id").alias("evidence"))
    by_kind = F.when(F.col("basis") == "derived", F.col("evidence").isNotNull()).when(F.col("basis") == "asserted", visible(who))
    return facts.join(backed, "fact_id", "left").where(by_kind).withColumn("evidence", F.coalesce("evidence", F.lit(0).cast("long")))


def known_at(valid: Column, recorded: Column) -> Column:
    """Both clocks, half-open: true of the world at ``valid``, and recorded but not retracted at ``recorded``."""
    return holds_at(valid) & holds_at(recorded, "recorded_at", "retracted_at")


def drawn_under(facts: DataFrame, seen: DataFrame, template: str | None) -> DataFrame:
    """Facts with readable evidence drawn under a template. Asked of the evidence, as facts merge across records."""
    return facts if template is None else facts.join(seen.where(F.col("template") == template).select("fact_id"), "fact_id", "left_semi")


def from_source(facts: DataFrame, seen: DataFrame, data_id=None, members: DataFrame | None = None) -> DataFrame:
    """Facts with a piece of readable evidence that is the record ``data_id``, if given, and in ``members`` (data_id), if given."""
    if data_id is None and members is None:
        return facts
    own = seen if data_id is None else seen.where(F.col("data_id") == data_id)
    own = own if members is None else own.join(members.select("data_id"), "data_id", "left_semi")
    return facts.join(own.select("fact_id"), "fact_id", "left_semi")


def walk(facts: DataFrame, mentioned: DataFrame, roots: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """The entities within ``hops`` of the roots (id) and the facts between them. ``facts`` are those seen and in force, so that no
    path leads through another; an entity is named, and a walk starts, only where a record that may be read mentions it.

    mentioned: id. Returns (id, hops) and the induced facts."""
    names = mentioned.select("id").distinct()
    reached = neighbourhood(facts.select(F.col("subject").alias("a"), F.col("object").alias("b")), roots.join(names, "id", "left_semi"), hops)
    nodes = reached.groupBy("id").agg(F.min("hops").alias("hops")).join(names, "id", "left_semi")
    end = lambda side: nodes.select(F.col("id").alias(side))
    return nodes, facts.join(end("subject"), "subject", "left_semi").join(end("object"), "object", "left_semi")


def seeds(entities: DataFrame, mentioned: DataFrame, question: str, least: int = 3, most: int = 8) -> DataFrame:
    """entities: id, name (normal form). Those whose name stands in the normal form of a question, longest names first, ties by id."""
    named = entities.where((F.length("name") >= least) & F.contains(F.lit(question), F.col("name")))
    return named.join(mentioned.select("id"), "id", "left_semi").orderBy(F.length("name").desc(), "id").limit(most)


def history(facts: DataFrame, entity: str) -> DataFrame:
    """Every visible fact that touched an entity, closed, open and retracted alike."""
    return facts.where((F.col("subject") == entity) | (F.col("object") == entity))


def asserted(facts: DataFrame, claims: DataFrame, entities: DataFrame, predicates: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """States facts outright. facts and claims: fact_id, subject, predicate, object, valid_from, recorded_at, retracted_at, valid_to, basis, confidence,
    the level; entities: id. Returns the facts after it, and what was refused: fact_id, error.

    An unknown relation, an entity related to itself and an entity that is not there are refused. A claim equal to an open fact is that
    fact: its start may move back and the best confidence stands; others are new facts with ``basis`` asserted. A claim counts once."""
    known = entities.select("id").distinct()
    ends = claims.join(known.select(F.col("id").alias("subject"), F.lit(True).alias("_s")), "subject", "left").join(known.select(F.col("id").alias("object"), F.lit(True).alias("_o")), "object", "left")
    error = F.when(~F.coalesce(F.col("predicate").isin(*predicates), F.lit(False)), "unknown_predicate").when(F.col("subject") == F.col("object"), "related_to_itself").when(F.col("_s").isNull() | F.col("_o").isNull(), "entity_not_found")
    told = ends.withColumn("error", error)
    key = ["subject", "predicate", "object"]
    good = told.where("error is null").select(*claims.columns)
    first = good.groupBy(*key).agg(F.min_by(F.struct(*[c for c in claims.columns if c not in key]), "fact_id").alias("x"), F.min("valid_from").alias("_from"), F.max("confidence").alias("_best"))
    is_open = F.col("valid_to").isNull() & F.col("retracted_at").isNull()
    met = facts.join(first.select(*key, "_from", "_best"), key, "left")
    kept = met.select(*[F.when(is_open, F.least("valid_from", "_from")).otherwise(F.col(c)).alias(c) if c == "valid_from" else F.when(is_open, F.greatest("confidence", "_best")).otherwise(F.col(c)).alias(c) if c == "confidence" else F.col(c) for c in facts.columns])
    fresh = first.join(facts.where(is_open).select(*key), key, "left_anti")
    new = fresh.select(*[F.lit("asserted").alias(c) if c == "basis" else F.col("_from").alias(c) if c == "valid_from" else F.col("_best").alias(c) if c == "confidence" else F.col(c) if c in key else F.col(f"x.{c}").alias(c) for c in facts.columns])
    return kept.unionByName(new), told.where("error is not null").select("fact_id", "error")


def retracted(facts: DataFrame, which: DataFrame, at: Column) -> DataFrame:
    """which: fact_id, reason. Claims withdrawn and kept: what was believed before ``at`` can still be told; one that was withdrawn before stays as it is."""
    met = facts.join(which.groupBy("fact_id").agg(F.min("reason").alias("_why"), F.lit(True).alias("_hit")), "fact_id", "left")
    now = F.col("_hit") & F.col("retracted_at").isNull()
    changed = {"retracted_at": at, "retracted_reason": F.col("_why")}
    return met.select(*[F.when(now, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in facts.columns])


def listed_entities(mentioned: DataFrame) -> DataFrame:
    """mentioned: id, data_id of readable mentions -> id, records: an entity is there for a reader as far as they can read of it."""
    return mentioned.groupBy("id").agg(F.countDistinct("data_id").alias("records"))


def entity_view(entity: str, mentioned: DataFrame, facts: DataFrame, top: int = 5) -> DataFrame:
    """One row for an entity as a reader sees it: id, records, facts (held, of either end), open_facts, beside: the ``top`` entities named in most of the same
    records, with their number. facts: those that the reader sees. An entity of which nothing can be read has no row."""
    mine = mentioned.where(F.col("id") == entity).select("data_id").distinct()
    beside = mentioned.where(F.col("id") != entity).join(mine, "data_id", "left_semi").groupBy("id").agg(F.countDistinct("data_id").alias("n"))
    first = beside.orderBy(F.desc("n"), "id").limit(top).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "id"))), lambda x: F.concat(x["id"], F.lit("="), (-x["less"]).cast("string"))), ",").alias("beside"))
    own = history(facts, entity).agg(F.count("*").alias("facts"), F.count_if(F.col("valid_to").isNull() & F.col("retracted_at").isNull()).alias("open_facts"))
    return mine.agg(F.count("*").alias("records")).where("records > 0").select(F.lit(entity).alias("id"), "records").crossJoin(own).crossJoin(first)
