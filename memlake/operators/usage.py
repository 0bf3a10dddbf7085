"""Credits, budgets and admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.operators.folds import folded


def credits(tokens_in: Column, tokens_out: Column, cached: Column, embeds: Column) -> Column:
    """Whole credits of a call: generation weighs tokens 1, 4 and 0.25, embedding 0.1, 0 and 0, per thousand and rounded up; at
    least 1 if any token was used, else 0. Rates are integers here so that the division is the only rounding."""
    milli = F.when(embeds, tokens_in * 100).otherwise(tokens_in * 1000 + tokens_out * 4000 + cached * 250)
    return F.when(tokens_in + tokens_out + cached <= 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(milli / F.lit(1_000_000.0)))).cast("long")


def binding_limit(*limits: Column) -> Column:
    """The least of the limits along the ancestry that are set; null if none is."""
    return F.least(*limits)


def token_bucket(calls: DataFrame, capacity: float, per_hour: float) -> DataFrame:
    """calls: key, ts, event_id, credits -> key, event_id, admitted, level. The bucket leaks ``per_hour`` credits; a call is admitted
    if its credits fit under ``capacity``. State depends on all earlier calls of a key, so each key is folded in order."""

    def step(state: tuple, row: dict) -> tuple[tuple, list[tuple]]:
        level, before = state
        if before is not None:
            level = max(0.0, level - (row["ts"] - before).total_seconds() / 3600 * per_hour)
        ok = level + row["credits"] <= capacity
        level += row["credits"] if ok else 0
        return (level, row["ts"]), [(row["key"], row["event_id"], ok, round(level, 6))]

    rows = calls.select("key", "ts", "event_id", "credits")
    return folded(rows, "key", ["ts", "event_id"], lambda _: (0.0, None), step, lambda _: (), "key long, event_id long, admitted boolean, level double")
