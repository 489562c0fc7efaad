"""Splitting an amount over members to the cent; each rule keeps the total exactly.

Amounts are whole cents in a long column. All rules are one window over the group, so the group's
rows meet in one task; a group is an order or a promotion within it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def largest_remainder(rows: DataFrame, group: list[str], total: Column, weight: Column, tie: list[str]) -> DataFrame:
    """`allocated`: the floor of each share, and a cent more for the largest remainders.

    Weights are whole and not all zero; ties go by the tie columns. A negative total is split as
    its absolute value.
    """
    whole = Window.partitionBy(group)
    size = F.abs(total).cast("decimal(38,0)")
    rows = rows.withColumn("_w", F.sum(weight).over(whole)).withColumn("_x", size * weight.cast("decimal(18,0)"))
    rows = rows.withColumn("_floor", F.floor(F.col("_x") / F.col("_w")).cast("long")).withColumn("_rest", (F.col("_x") - F.col("_floor") * F.col("_w")).cast("decimal(38,0)"))
    rows = rows.withColumn("_left", F.abs(total) - F.sum("_floor").over(whole)).withColumn("_rank", F.row_number().over(whole.orderBy(F.desc("_rest"), *tie)))
    share = F.col("_floor") + F.when(F.col("_rank") <= F.col("_left"), 1).otherwise(0)
    return rows.withColumn("allocated", (F.when(total < 0, -share).otherwise(share)).cast("long")).drop("_w", "_x", "_floor", "_rest", "_left", "_rank")


def last_takes_rest(rows: DataFrame, group: list[str], total: Column, weight: Column, order: list[str]) -> DataFrame:
    """`allocated`: each share rounded half-even, the last member takes what is left."""
    whole, running = Window.partitionBy(group), Window.partitionBy(group).orderBy(*order)
    share = F.bround(total.cast("decimal(20,0)") * weight.cast("decimal(17,0)") / F.sum(weight).over(whole).cast("decimal(18,0)"), 0).cast("long")
    rows = rows.withColumn("_share", share)
    before = F.coalesce(F.sum("_share").over(running.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.row_number().over(running) == F.count("*").over(whole)
    return rows.withColumn("allocated", F.when(last, total - before).otherwise(F.col("_share")).cast("long")).drop("_share")


def earliest_units(rows: DataFrame, group: list[str], total: Column, units: Column, order: list[str]) -> DataFrame:
    """`allocated`: every unit gets the same cents, the earliest units one more until the rest is gone."""
    whole, running = Window.partitionBy(group), Window.partitionBy(group).orderBy(*order)
    all_units = F.sum(units).over(whole)
    each, rest = F.floor(total / all_units).cast("long"), F.pmod(total, all_units)
    before = F.coalesce(F.sum(units).over(running.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    extra = F.greatest(F.lit(0), F.least(units, rest - before))
    return rows.withColumn("allocated", (each * units + extra).cast("long"))
