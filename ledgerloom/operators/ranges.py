"""Running sums in an order that no task sees as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.lineage import cut


def sum_before(rows: DataFrame, group: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """rows with the sum of value over the rows of the same group that come before in order; the order has no ties within a group.

    Rows are dealt by range of (group, order), so a large group is in many ranges; what a group has in
    earlier ranges, one number for each, is added. group has no nulls."""
    dealt = cut(rows.repartitionByRange(*group, *order).withColumns({"__part": F.spark_partition_id(), "__value": value}), "ranges")
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*group, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*group, "__part").agg(F.sum("__value").alias("__sum")).withColumn("__start", F.sum("__sum").over(earlier)).where("__start is not null").drop("__sum")
    both = dealt.withColumn(name, F.coalesce(F.sum("__value").over(inside), F.lit(0))).join(starts, [*group, "__part"], "left")
    return both.withColumn(name, F.col(name) + F.coalesce("__start", F.lit(0))).select(*(c for c in rows.columns if c != name), name)
