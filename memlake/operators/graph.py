"""Claims on two clocks, evidence, supersession, and walks."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators.folds import folded
from memlake.operators.written import written


def holds_at(when: Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    """Half-open: start <= when < end, an open end never passed."""
    return (F.col(start) <= when) & (F.col(end).isNull() | (when < F.col(end)))


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """edges: a, b, undirected; seeds: id. Each reachable id with its least number of hops. Unrolled frontier joins: each level
    joins only what is new and drops what was met before, so paths are not enumerated; frontiers are written, so plans stay small."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    met = seeds.select("id", F.lit(0).alias("hops")).distinct()
    frontier = met
    for h in range(1, hops + 1):
        step = frontier.join(both.withColumnRenamed("a", "id"), "id").select(F.col("b").alias("id")).distinct().join(met.select("id"), "id", "left_anti")
        frontier = written(step.withColumn("hops", F.lit(h)))
        met = met.union(frontier)
    return met


@dataclass
class Fact:
    object: object
    fact_id: object
    valid_from: object
    confidence: float | None
    evidence: int = 1


class OpenFacts:
    """The facts of one subject and relation that are open, by object, and a heap by start, so that a claim looks only at what it closes."""

    def __init__(self, key: tuple) -> None:
        self.key, self.open, self.heap, self.pushed = key, {}, [], 0

    def _push(self, fact: Fact) -> None:
        self.pushed += 1
        heapq.heappush(self.heap, (fact.valid_from, self.pushed, fact))

    def row(self, fact: Fact, valid_to=None, by=None) -> tuple:
        return (*self.key, fact.object, fact.fact_id, fact.valid_from, valid_to, fact.evidence, fact.confidence, by)

    def claim(self, object_, fact_id, valid_from, confidence, single: bool) -> list[tuple]:
        """The facts that the claim closes."""
        fact = self.open.get(object_)
        if fact is None:
            fact = self.open[object_] = Fact(object_, fact_id, valid_from, confidence)
            self._push(fact)
        else:
            fact.evidence += 1
            fact.confidence = max((c for c in (fact.confidence, confidence) if c is not None), default=None)
            if valid_from < fact.valid_from:
                fact.valid_from = valid_from
                self._push(fact)
        closed = []
        while single and self.heap and self.heap[0][0] < valid_from:
            start, _, other = heapq.heappop(self.heap)
            if other is fact:
                closed.append(None)
            elif self.open.get(other.object) is other and other.valid_from == start:
                closed.append(self.row(self.open.pop(other.object), valid_from, fact.fact_id))
        if None in closed:
            self._push(fact)
        return [x for x in closed if x]

    def left(self) -> list[tuple]:
        return [self.row(f) for f in self.open.values()]


def facts_of_claims(claims: DataFrame, single_valued: tuple[str, ...]) -> DataFrame:
    """claims: subject, predicate, object, valid_from, fact_id (order of arrival), confidence -> the facts they leave: subject, predicate, object,
    fact_id, valid_from, valid_to, evidence, confidence, superseded_by.

    A claim equal to an open fact is more evidence for it: it may move its start back, and the best confidence stands. A claim of a
    single-valued relation closes, at its own date, the subject's other open facts of that relation that start strictly earlier; an older
    claim that arrives late stays open beside the newer one, and facts of the same start contradict each other. Claims without a subject, an
    object or a date state nothing and go."""
    whole = claims.where("subject is not null and object is not null and valid_from is not null")
    rows = whole.select(F.struct("subject", "predicate").alias("key"), "object", "valid_from", "fact_id", "confidence")
    kinds = dict(claims.dtypes)
    schema = f"subject {kinds['subject']}, predicate string, object {kinds['object']}, fact_id {kinds['fact_id']}, valid_from {kinds['valid_from']}, valid_to {kinds['valid_from']}, evidence int, confidence double, superseded_by {kinds['fact_id']}"

    def step(state: OpenFacts, row: dict) -> tuple[OpenFacts, list[tuple]]:
        return state, state.claim(row["object"], row["fact_id"], row["valid_from"], row["confidence"], row["key"]["predicate"] in single_valued)

    return folded(rows, "key", ["fact_id"], lambda k: OpenFacts((k["subject"], k["predicate"])), step, OpenFacts.left, schema)


def supersede(claims: DataFrame) -> DataFrame:
    """claims of one single-valued relation: subject, object, valid_from, fact_id -> the facts they leave: subject, object, fact_id, valid_from,
    valid_to, evidence."""
    named = claims.select("subject", F.lit("").alias("predicate"), "object", "valid_from", "fact_id", F.lit(None).cast("double").alias("confidence"))
    return facts_of_claims(named, ("",)).select("subject", "object", "fact_id", "valid_from", "valid_to", "evidence")


def evidence_of(claims: DataFrame, shown: int = 3, salts: int = 32) -> DataFrame:
    """claims: subject, object, fact_id, valid_from -> subject, object, evidence (distinct claims), valid_from, last_seen, sources (the ``shown`` least claims).

    Claims are made distinct and ranked within salted parts of an edge first, so no state grows with an edge however often it is asserted."""
    edge = ["subject", "object"]
    once = claims.groupBy(*edge, "fact_id").agg(F.min("valid_from").alias("valid_from"), F.max("valid_from").alias("last_seen")).withColumn("salt", F.pmod(F.xxhash64("fact_id"), F.lit(salts)))
    whole = once.groupBy(*edge).agg(F.count("*").alias("evidence"), F.min("valid_from").alias("valid_from"), F.max("last_seen").alias("last_seen"))
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("fact_id"))
    few = once.select(*edge, "salt", "fact_id").withColumn("place", place(*edge, "salt")).where(F.col("place") <= shown).withColumn("place", place(*edge)).where(F.col("place") <= shown)
    named = few.groupBy(*edge).agg(F.array_join(F.transform(F.array_sort(F.collect_list("fact_id")), lambda x: x.cast("string")), ",").alias("sources"))
    return whole.join(named, edge)


def conflicts(facts: DataFrame) -> DataFrame:
    """facts: subject, predicate (perhaps), object, valid_from, valid_to. Relations of a subject with more than one open fact, their objects by start;
    facts without a predicate are of one relation."""
    by = ["subject", "predicate"] if "predicate" in facts.columns else ["subject"]
    g = facts.where("valid_to is null").groupBy(*by)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("valid_from", "object"))), lambda x: x["object"])
    return g.agg(F.count("*").alias("claims"), F.array_join(listed, ",").alias("objects")).where("claims > 1")


def co_mentioned(mentions: DataFrame, entity) -> DataFrame:
    """mentions: entity, data_id. Entities mentioned in the same records as ``entity``, with the number of such records."""
    mine = mentions.where(F.col("entity") == entity).select("data_id").distinct()
    return mentions.where(F.col("entity") != entity).join(mine, "data_id", "left_semi").groupBy("entity").agg(F.countDistinct("data_id").alias("records"))
