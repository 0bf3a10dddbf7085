"""Shared checks of embedding vectors."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vec: str) -> Column:
    """Not null, not empty, every component present and finite."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(vec).isNotNull() & (F.size(vec) > 0) & ~bad, F.lit(False))
