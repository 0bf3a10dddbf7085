"""Erasure by a registry of stores: what refers to an erased record goes, however far; what stood on it is marked; and a proof that looks again."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.operators.written import written


@dataclass(frozen=True)
class Reference:
    """Rows of ``child`` name a row of ``parent`` and go with it."""

    child: str
    column: str
    parent: str


@dataclass(frozen=True)
class Mark:
    """Rows of ``store`` that ``where`` admits are not deleted but changed: ``values`` (column to SQL expression) where rows of ``by`` that name them are
    all gone (``none_left``), or where some are (``any_lost``)."""

    store: str
    by: str
    column: str
    when: str
    where: str
    values: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Registry:
    """``root`` holds the records; ``keys`` names the key of each store; ``cleared`` is what the tombstone of a record loses."""

    root: str
    keys: dict[str, str]
    references: tuple[Reference, ...]
    marks: tuple[Mark, ...]
    cleared: tuple[str, ...]


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, frames).distinct()


def reached(stores: dict[str, DataFrame], registry: Registry, gone: DataFrame) -> dict[str, DataFrame]:
    """The keys of each store that go with the records ``gone`` (one column): references followed until no store has new ones, so that chains
    and stores that refer to themselves are walked to their end. Each level is written, and joins only what is new."""
    new = {registry.root: gone.distinct()}
    met = dict(new)
    while new:
        found: dict[str, list[DataFrame]] = {}
        for r in registry.references:
            if r.parent in new:
                child, key = stores[r.child], registry.keys[r.child]
                lost = new[r.parent].toDF(r.column)
                found.setdefault(r.child, []).append(child.where(F.col(r.column).isNotNull()).join(lost, r.column, "left_semi").select(key))
        new = {}
        for name, frames in found.items():
            fresh = _union(frames)
            fresh = written(fresh.join(met[name], registry.keys[name], "left_anti") if name in met else fresh)
            if not fresh.isEmpty():
                new[name] = fresh
                met[name] = met[name].union(fresh) if name in met else fresh
    return met


def purge(stores: dict[str, DataFrame], registry: Registry, gone: DataFrame, at: str) -> dict[str, DataFrame]:
    """All stores after the erasure of the records ``gone``. A tombstone of each record stays, with ``purged_at`` and without its content. Purging
    again changes nothing."""
    lost = reached(stores, registry, gone)
    after = {n: s if n not in lost or n == registry.root else s.join(lost[n], registry.keys[n], "left_anti") for n, s in stores.items()}
    root, key = stores[registry.root], registry.keys[registry.root]
    dead = root.join(lost[registry.root].toDF(key).withColumn("_gone", F.lit(True)), key, "left")
    once = F.when(F.col("_gone"), F.coalesce("purged_at", F.lit(at).cast("timestamp_ntz"))).otherwise(F.col("purged_at"))
    after[registry.root] = dead.select(*[F.when(F.col("_gone"), F.lit(None)).otherwise(F.col(c)).alias(c) if c in registry.cleared else once.alias(c) if c == "purged_at" else F.col(c) for c in root.columns])
    for m in registry.marks:
        key = registry.keys[m.store]
        if m.when == "none_left":
            left = after[m.by].select(F.col(m.column).alias(key), F.lit(True).alias("_hit")).where(F.col(key).isNotNull()).distinct()
            hit = F.col("_hit").isNull()
        else:
            left = stores[m.by].join(lost[m.by], registry.keys[m.by], "left_semi").select(F.col(m.column).alias(key), F.lit(True).alias("_hit")).distinct() if m.by in lost else None
            hit = F.col("_hit").isNotNull()
        if left is None:
            continue
        met, values = after[m.store].join(left, key, "left"), dict(m.values)
        touched = hit & F.expr(m.where)
        after[m.store] = met.select(*[F.when(touched, F.expr(values[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in stores[m.store].columns])
    return after


def proof(stores: dict[str, DataFrame], registry: Registry, gone: DataFrame) -> DataFrame:
    """store, remaining, complete: what still tells of the records ``gone``, found by looking and not by what a purge reports.

    For each store: rows that name an erased record, or name a parent that is not there; rows that a mark should have changed and that
    are open with nothing behind them; and for the records themselves, tombstones that are missing, unstamped or not cleared."""
    counts = []
    for r in registry.references:
        child = stores[r.child].where(F.col(r.column).isNotNull())
        if r.parent == registry.root:
            hit = child.join(gone.distinct().toDF(r.column), r.column, "left_semi")
        else:
            hit = child.join(stores[r.parent].select(F.col(registry.keys[r.parent]).alias(r.column)), r.column, "left_anti")
        counts.append(hit.agg(F.count("*").alias("remaining")).select(F.lit(r.child).alias("store"), "remaining"))
    for m in registry.marks:
        if m.when == "none_left":
            key = registry.keys[m.store]
            held = stores[m.by].select(F.col(m.column).alias(key)).where(F.col(key).isNotNull())
            open_ = stores[m.store].where(m.where).join(held, key, "left_anti")
            counts.append(open_.agg(F.count("*").alias("remaining")).select(F.lit(m.store).alias("store"), "remaining"))
    key = registry.keys[registry.root]
    met = gone.distinct().toDF(key).join(stores[registry.root], key, "left")
    told = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in registry.cleared], F.col("purged_at").isNull())
    counts.append(met.agg(F.coalesce(F.count_if(told), F.lit(0)).alias("remaining")).select(F.lit(registry.root).alias("store"), "remaining"))
    return reduce(DataFrame.union, counts).groupBy("store").agg(F.sum("remaining").alias("remaining")).withColumn("complete", F.col("remaining") == 0)
