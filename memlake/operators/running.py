"""Numbers, running sums and the row before, within keys that may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators.written import written


def running(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, before: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with ``n``, their number within the key by ``order`` (from 1), for each of ``sums`` the sum over the rows before (0 for the first), and for
    each of ``before`` its value on the row before (null for the first). ``order`` decides; rows equal in it come in any order.

    Rows are dealt by range of key and order, so a large key lies in many blocks; the blocks of a key are summed first, one row for each,
    and only within a block does a window run. A null in a sum counts as nothing; a null key is a key."""
    sums, before = sums or {}, before or {}
    held = rows.select("*", *[F.coalesce(v, F.lit(0)).alias(f"_s_{k}") for k, v in sums.items()], *[F.struct(v.alias("v")).alias(f"_b_{k}") for k, v in before.items()])
    dealt = written(held.repartitionByRange(*keys, *order).withColumn("_block", F.spark_partition_id()))
    at = F.struct(*order)
    blocks = dealt.groupBy(*keys, "_block").agg(F.count("*").alias("_n"), *[F.sum(f"_s_{k}").alias(f"_t_{k}") for k in sums], *[F.max_by(f"_b_{k}", at).alias(f"_l_{k}") for k in before])
    earlier = Window.partitionBy(*keys).orderBy("_block")
    so_far = earlier.rowsBetween(Window.unboundedPreceding, -1)
    key = F.struct(*keys)
    offsets = blocks.select(
        F.hash(*keys).alias("_h"), key.alias("_key"), "_block", F.coalesce(F.sum("_n").over(so_far), F.lit(0)).alias("_o_n"),
        *[F.coalesce(F.sum(f"_t_{k}").over(so_far), F.lit(0)).alias(f"_o_{k}") for k in sums], *[F.lag(f"_l_{k}").over(earlier).alias(f"_p_{k}") for k in before])
    met = dealt.withColumn("_h", F.hash(*keys)).withColumn("_key", key).alias("d").join(offsets.alias("o"), (F.col("d._h") == F.col("o._h")) & (F.col("d._block") == F.col("o._block")) & F.col("d._key").eqNullSafe(F.col("o._key")))
    inside = Window.partitionBy(*[F.col(f"d.{k}") for k in keys], F.col("d._block")).orderBy(*[F.col(f"d.{c}") for c in order])
    above = inside.rowsBetween(Window.unboundedPreceding, -1)
    return met.select(
        *[F.col(f"d.{c}") for c in rows.columns], (F.col("_o_n") + F.row_number().over(inside)).alias("n"),
        *[(F.col(f"_o_{k}") + F.coalesce(F.sum(f"d._s_{k}").over(above), F.lit(0))).alias(k) for k in sums],
        *[F.coalesce(F.lag(f"d._b_{k}").over(inside), F.col(f"_p_{k}"))["v"].alias(k) for k in before])
