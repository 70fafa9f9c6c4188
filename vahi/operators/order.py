"""Positions in an order within groups, where a group may hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vahi.storage import stored, tasks


def positions(rows: DataFrame, by: str, order: Sequence[Column], name: str = "position") -> DataFrame:
    """rows with each row's place, from 1, in the order within its group.

    Rows are dealt to ranges of (group, order) and sorted there, so a large group spreads over many tasks, and numbered in their partition by Spark itself. A row's place is that number less
    the first one of its group in the range, plus the rows of the group in the ranges before: one small row each group and range, so the rows are shuffled once.
    The order must be total within a group for a stable result.
    """
    spark, keys = rows.sparkSession, [F.col(by).asc_nulls_first(), *order]
    dealt = rows.repartitionByRange(tasks(spark), *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    dealt = stored(dealt.withColumn("_part", F.shiftright("_at", 33)), "positions")  # the bits above 33 are the partition, the others the row's number in it
    counts = dealt.groupBy(by, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = counts.select(F.col(by).alias("_by"), F.col("_part").alias("_p"), (earlier - F.col("_first") + 1).alias("_shift"))
    placed = dealt.join(_few(before), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_p")))
    return placed.withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_p", "_by", "_shift")


#: Rows, one each group and range, that are broadcast at most.
FEW_ROWS = 200_000


def _few(rows: DataFrame) -> DataFrame:
    """rows to be broadcast if, counted first, they are few; else as they are, for a join by shuffle."""
    rows = stored(rows, "offsets")
    return F.broadcast(rows) if rows.count() <= FEW_ROWS else rows


def earlier_sums(rows: DataFrame, by: Sequence[str], order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with, in each group, the sum of each value over all rows before it in the order, 0 for the first ones.

    Rows are dealt to ranges of (group, order); the totals of each group in each range are carried to the ranges after it, so no group is one task. Values must be exact numbers
    (whole or decimal) and not null; the order must be total within a group.
    """
    keys = [F.col(c).asc_nulls_first() for c in by]
    valued = rows.withColumns({f"_{k}": v for k, v in sums.items()})
    dealt = stored(valued.repartitionByRange(tasks(rows.sparkSession), *keys, *order).withColumn("_part", F.spark_partition_id()), "sums")
    totals = dealt.groupBy(*by, "_part").agg(*[F.sum(f"_{k}").alias(f"_all_{k}") for k in sums])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_part").alias("_p"), *[F.sum(f"_all_{k}").over(before).alias(f"_before_{k}") for k in sums])
    inside = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("_part") == F.col("_p")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    met = dealt.withColumns({f"_inside_{k}": F.sum(f"_{k}").over(inside) for k in sums}).join(_few(carried), same)
    return met.select(*rows.columns, *[(F.coalesce(f"_before_{k}", F.lit(0)) + F.coalesce(f"_inside_{k}", F.lit(0))).alias(k) for k in sums])
