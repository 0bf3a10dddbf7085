"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

A token budget flows down a tree (domain, language, source). Each node's budget is split among its children by their weights; a
child takes at most what its leaves can give in ``max_epochs`` passes, and what it cannot take goes to its siblings by weight.
Since a child's limit counts its whole subtree, a shortage is met among siblings before it reaches ancestors. The split is
the closed form of water-filling: children in order of limit over weight, the saturated ones first. Each leaf then gives whole
epochs and a token-prefix of one more, in an order seeded by epoch. The prefix is found without sorting a leaf in one task:
units fall into hash buckets of about BUCKET units, bucket sums are accumulated, and only the bucket where the budget ends is
ordered.

A unit is a document id: rows that share an id are one unit with their tokens summed and the least level names. Rows with a null
id are one unit only where their levels and texts are equal. Null levels are the level ``null``. Weights are by path ("a", "a/b", ...) or, failing that, by the level's own name, failing that
1; weight 0 takes nothing. Units without tokens are never selected. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.best_fit import word_count
from memlake.llm.common import cut, packed, unpacked

BUCKET = 4096
_BITS = 40


def _weight(paths: list[str], weights: dict[str, float]) -> Column:
    path, name = F.concat_ws("/", *paths), F.col(paths[-1])
    out = F.lit(1.0)
    for key, w in weights.items():
        if "/" not in key:
            out = F.when(name == key, float(w)).otherwise(out)
    for key, w in weights.items():
        if "/" in key or len(paths) == 1:
            out = F.when(path == key, float(w)).otherwise(out)
    return out


def _order(seed: int, epoch: Column) -> Column:
    """40 seeded bits of a unit in an epoch."""
    key = F.concat_ws(":", F.lit(seed).cast("string"), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.col("unit"))))
    return F.conv(F.substring(F.md5(key), 1, _BITS // 4), 16, 10).cast("long")


def budgets(leaves: DataFrame, levels: list[str], weights: dict[str, float], budget: float, max_epochs: int) -> DataFrame:
    """leaves: levels, tokens, units -> the same with ``budget``, whole tokens for each leaf."""
    rows = leaves.withColumn("limit", F.col("tokens").cast("double") * max_epochs)
    total = Window.partitionBy(F.lit(0))
    rows = cut(rows)
    whole = rows.agg(F.sum("limit").alias("limit")).withColumn("given", F.least(F.coalesce("limit", F.lit(0.0)), F.lit(float(budget)))).select("given")
    given = whole.first().given
    shared = None
    for depth in range(1, len(levels) + 1):
        own, above = levels[:depth], levels[: depth - 1]
        nodes = rows.groupBy(*own).agg(F.sum("limit").alias("limit")).withColumn("w", _weight(own, weights))
        nodes = nodes.where("w > 0").join(shared, above) if shared is not None else nodes.where("w > 0").withColumn("given", F.lit(given))
        group = Window.partitionBy(*above) if above else total
        run = group.orderBy(F.col("limit") / F.col("w"), *own)
        before = run.rowsBetween(Window.unboundedPreceding, -1)
        sums = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0.0))
        nodes = nodes.select("*", (F.col("limit") * (F.sum("w").over(group) - sums("w", before)) <= F.col("w") * (F.col("given") - sums("limit", before)) * (1 + 1e-12)).alias("full"))
        held = lambda c: F.sum(F.when(F.col("full"), F.col(c)).otherwise(0.0)).over(group)
        rest = F.col("w") * (F.col("given") - held("limit")) / (F.sum("w").over(group) - held("w"))
        shared = nodes.select(*own, F.when(F.col("full"), F.col("limit")).otherwise(F.least("limit", rest)).alias("given"))
    return rows.join(shared, levels).select(*levels, "tokens", "units", F.floor(F.col("given") + 1e-6).cast("long").alias("budget"))


def nameless(id_col: Column, levels: list[Column], content: Column) -> Column:
    """What tells rows with a null id apart: a hash of levels and content; null where there is an id."""
    return F.when(id_col.isNull(), F.xxhash64(*[F.coalesce(c.cast("string"), F.lit("null")) for c in levels], content))


def _base(docs: DataFrame, levels: list[str], id_col: str, text_col: str, count_col: str | None) -> DataFrame:
    own = nameless(F.col(id_col), [F.col(c) for c in levels], F.col(count_col or text_col))
    return docs.select(F.col(id_col).alias("doc_id"), own.alias("unit"), *[_level(c).alias(c) for c in levels], (F.col(count_col).cast("long") if count_col else word_count(text_col)).alias("n_tokens"))


def _level(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("null"))


def _selected(units: DataFrame, levels: list[str], weights: dict[str, float], share: float, max_epochs: int, seed: int) -> DataFrame:
    """The units (cut) that are selected: their leaf's whole epochs and the part of their tokens taken in the one after those."""
    leaves = cut(units.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("units")))
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first().n
    plan = budgets(leaves, levels, weights, float(int(total * share)), max_epochs)
    plan = cut(plan.select(*levels, F.floor(F.col("budget") / F.col("tokens")).cast("int").alias("whole"), (F.col("budget") % F.col("tokens")).alias("rest"), F.ceil(F.col("units") / BUCKET).cast("long").alias("buckets")))
    placed = units.join(plan, levels).withColumn("order", _order(seed, F.col("whole")))
    placed = cut(placed.withColumn("bucket", F.floor(F.col("order").cast("double") / float(1 << _BITS) * F.col("buckets")).cast("long")))
    run = Window.partitionBy(*levels).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*levels, "bucket").agg(F.sum("n_tokens").alias("held"), F.first("rest").alias("rest"))
    sums = cut(sums.withColumn("before", F.coalesce(F.sum("held").over(run), F.lit(0))).select(*levels, "bucket", "held", "before"))
    rows = placed.join(sums, [*levels, "bucket"])
    ends = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("held") > F.col("rest"))
    inside = Window.partitionBy(*levels, "bucket").orderBy("order", "doc_id", "unit").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.where(ends).withColumn("room", F.col("rest") - F.col("before") - F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    last = last.withColumn("part", F.greatest(F.lit(0), F.least("n_tokens", "room")))
    other = rows.where(~ends).withColumn("part", F.when(F.col("before") < F.col("rest"), F.col("n_tokens")).otherwise(0))
    keep = ["doc_id", "unit", *levels, "n_tokens", "order", "whole", "part"]
    return last.select(*keep).union(other.select(*keep)).where("whole > 0 or part > 0")


def mix(docs: DataFrame, levels: list[str], weights: dict[str, float], share: float = 1.0, max_epochs: int = 4, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """doc_id, unit (of rows with a null id, see ``nameless``), the levels, epoch (from 0), n_tokens, taken (tokens used in that epoch). Budget: ``share`` of all tokens."""
    base = _base(docs, levels, id_col, text_col, count_col)
    units = cut(base.groupBy("doc_id", "unit").agg(*[F.min(c).alias(c) for c in levels], F.sum("n_tokens").alias("n_tokens")).where("n_tokens > 0"))
    chosen = _selected(units, levels, weights, share, max_epochs, seed)
    epochs = F.sequence(F.lit(0), F.col("whole") - F.when(F.col("part") > 0, 0).otherwise(1))
    return chosen.select("*", F.explode(epochs).alias("epoch")).select("doc_id", "unit", *levels, "epoch", "n_tokens", F.when(F.col("epoch") < F.col("whole"), F.col("n_tokens")).otherwise(F.col("part")).alias("taken"))


def mixed(docs: DataFrame, levels: list[str], weights: dict[str, float], share: float = 1.0, max_epochs: int = 4, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, each once for every epoch that ``mix`` selects its unit in.

    Whole rows are not shuffled: a leaf's selection is its whole epochs and, in the order of the one after them, the last unit
    that takes part, so a row needs its leaf only. Rows whose id stands under several levels, or also on a row without
    tokens, find their unit's leaf by id. Rows without tokens are left out unless they share an id with one that has some."""
    base = _base(docs, levels, id_col, text_col, None)
    differs = [F.min(c) != F.max(c) for c in levels]
    uneven = reduce(Column.__or__, differs, (F.min("n_tokens") == 0)) & F.col("doc_id").isNotNull()
    units = cut(base.groupBy("doc_id", "unit").agg(*[F.min(c).alias(c) for c in levels], F.sum("n_tokens").alias("n_tokens"), uneven.alias("uneven")).where("n_tokens > 0"))
    chosen = _selected(units, levels, weights, share, max_epochs, seed)
    ends = cut(chosen.groupBy(*levels).agg(F.max("whole").alias("whole"), F.max(F.when(F.col("part") > 0, F.struct("order", "doc_id", "unit"))).alias("last")))
    several = cut(units.where("uneven").select(F.col("doc_id").alias("id"), F.struct(*levels).alias("of")))
    own = nameless(F.col(id_col), [F.col(c) for c in levels], F.col(text_col))
    worded = F.coalesce(F.col(text_col).cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = packed(docs, doc_id=F.col(id_col), unit=own, worded=worded, own=F.struct(*[_level(c).alias(c) for c in levels]))
    rows = rows.join(several, F.col("doc_id") == F.col("id"), "left").where(F.col("worded") | F.col("id").isNotNull())
    rows = rows.select("doc", "doc_id", "unit", F.coalesce("of", "own").alias("leaf")).select("doc", "doc_id", "unit", "leaf.*").join(ends, levels)
    part = F.coalesce(F.struct(_order(seed, F.col("whole")).alias("order"), "doc_id", "unit") <= F.col("last"), F.lit(False))
    times = (F.col("whole") + part.cast("int")).alias("times")
    rows = rows.select("doc", times).where("times > 0")
    return unpacked(rows.select("doc", F.explode(F.sequence(F.lit(1), "times")).alias("copy")), docs.columns)
