"""Running sums over a whole table, without a task that sees all of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.plans.scratch import Scratch


def before(df: DataFrame, order: Sequence[Column], sums: Sequence[str], scratch: Scratch) -> DataFrame:
    """Adds before_<c> for each column c of sums: its sum over the rows that come earlier in the order, 0 at the first
    one.  Nulls count nothing; rows that the order ties stand in any order.  Rows are dealt by ranges of the order, each
    range sums alone, and a table with one row for each range carries the ranges' totals on."""
    dealt = scratch.keep(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    zero = lambda c: F.coalesce(c, F.lit(0))
    up = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("__range").agg(*(F.sum(c).alias(f"__{c}") for c in sums))
    carried = totals.select("__range", *(zero(F.sum(f"__{c}").over(up)).alias(f"__{c}") for c in sums))
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(carried), "__range")
    return out.select(*df.columns, *((zero(F.sum(c).over(within)) + F.col(f"__{c}")).alias(f"before_{c}") for c in sums))
