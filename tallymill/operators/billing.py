"""Billing of committed statement batches: periods, rows, totals, controls and the staging rows of the ledger system."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.operators.products import MISSING, first_seen, single_value

MONEY = "decimal(18,2)"
PLACEHOLDER_NAV = "0"
NO_DESCRIPTION = "MISSING"


def committed(rows: DataFrame) -> DataFrame:
    """Order rows that passed validation and are committed."""
    return rows.where("validation = 'PASSED' AND commit = 'COMMITTED'")


def periods(rows: DataFrame) -> DataFrame:
    """One row per committed batch, newest first by end, start and id: its period and what is wrong with it.

    problem: CONFLICTING_FACTS, CONFLICTING_COUNT, DUPLICATE_ORDER, COUNT_MISMATCH, DUPLICATE_PERIOD or NULL.
    """
    own = rows.where("commit = 'COMMITTED'").groupBy("batch_id").agg(
        F.countDistinct(F.struct("file_hash", "period_from", "period_to")).alias("n_facts"),
        F.countDistinct("order_count").alias("n_counts"),
        F.max("order_count").alias("declared"),
        F.count("*").alias("n_orders"),
        F.countDistinct("order_id").alias("n_distinct"),
        F.max("period_from").alias("period_from"),
        F.max("period_to").alias("period_to"),
        F.sum("released").cast("decimal(28,2)").alias("released"),
    )
    same = F.count("*").over(Window.partitionBy("period_from", "period_to"))
    problem = (
        F.when(F.col("n_facts") > 1, "CONFLICTING_FACTS")
        .when(F.col("n_counts") > 1, "CONFLICTING_COUNT")
        .when(F.col("n_distinct") < F.col("n_orders"), "DUPLICATE_ORDER")
        .when(F.col("n_orders") != F.col("declared"), "COUNT_MISMATCH")
        .when(F.col("n_same") > 1, "DUPLICATE_PERIOD")
    )
    out = own.withColumn("n_same", same).select("batch_id", "period_from", "period_to", "n_orders", "declared", "released", problem.alias("problem"))
    return out.orderBy(F.desc("period_to"), F.desc("period_from"), F.desc("batch_id"))


def summary(items: DataFrame, keys: list[str], group: list[str]) -> DataFrame:
    """Billing rows of each group: quantity, amount and discount per key, numbered by nav, sku and price.

    items: nav, sku, price, quantity, amount among others. discount = price x quantity - amount.
    """
    rows = items.groupBy(*group, *keys).agg(F.sum("quantity").alias("quantity"), F.sum("amount").cast("decimal(28,2)").alias("amount"), F.count("*").alias("n_items"))
    rows = rows.withColumn("discount", (F.col("price") * F.col("quantity") - F.col("amount")).cast("decimal(28,2)"))
    return rows.withColumn("number", F.row_number().over(Window.partitionBy(group).orderBy(F.lower("nav"), "sku", "price")))


def totals(items: DataFrame, group: list[str]) -> DataFrame:
    """Per group: amounts of normal items and of promotions, how many promotions, and the quantities."""
    promoted = F.col("promotion").isNotNull()
    return items.groupBy(group).agg(
        F.sum(F.when(~promoted, F.col("amount"))).cast("decimal(28,2)").alias("normal_amount"),
        F.sum(F.when(promoted, F.col("amount"))).cast("decimal(28,2)").alias("promotion_amount"),
        F.countDistinct("promotion").alias("n_promotions"),
        F.count_if(~promoted).alias("n_normal"),
        F.sum("quantity").alias("quantity"),
    )


def controls(items: DataFrame, rows: DataFrame, group: list[str]) -> DataFrame:
    """Per group, items against their billing rows: which of quantity, amount, discount and number of items differ (none should)."""
    ours = items.groupBy(group).agg(F.sum("quantity").alias("q1"), F.sum("amount").alias("a1"), F.sum((F.col("price") * F.col("quantity") - F.col("amount"))).alias("d1"), F.count("*").alias("n1"))
    theirs = rows.groupBy(group).agg(F.sum("quantity").alias("q2"), F.sum("amount").alias("a2"), F.sum("discount").alias("d2"), F.sum("n_items").alias("n2"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    wrong = F.array_compact(F.array(*(F.when(~same(f"{c}1", f"{c}2"), n) for c, n in (("q", "QUANTITY"), ("a", "AMOUNT"), ("d", "DISCOUNT"), ("n", "POPULATION")))))
    return ours.join(theirs, group, "full_outer").select(*group, wrong.alias("wrong")).where(F.size("wrong") > 0)


def descriptions(master: DataFrame) -> DataFrame:
    """nav, n_descriptions and the description where it is the nav's only one; blanks and the placeholder nav don't count."""
    nav, text = F.trim("nav"), F.trim("description")
    usable = master.where((nav != "") & (nav != PLACEHOLDER_NAV) & (text != "")).select(nav.alias("nav"), text.alias("description"))
    return usable.groupBy("nav").agg(F.countDistinct("description").alias("n_descriptions"), single_value(F.col("description")).alias("description"))


def period_reference(start: Column, end: Column) -> Column:
    return F.concat(F.lit("SP"), F.date_format(start, "yyyyMMdd"), F.date_format(end, "MMdd"))


def staging(rows: DataFrame, described: DataFrame, group: list[str]) -> DataFrame:
    """Rows for the ledger system: one per group, nav, sku and price, in the order first seen, with the quantities added up.

    rows: group, number, nav, sku, price, quantity, reference, uom. conflict: a bucket's other fields differ.
    """
    own = rows.groupBy(*group, F.trim("nav").alias("nav"), "sku", "price").agg(F.sum("quantity").alias("quantity"), F.min("number").alias("first"), F.max("reference").alias("reference"), (F.countDistinct(F.struct("reference", F.coalesce("uom", F.lit(MISSING)))) > 1).alias("conflict"))
    named = own.join(described.select("nav", "description"), "nav", "left").withColumn("description", F.coalesce("description", F.lit(NO_DESCRIPTION)))
    return named.withColumn("line", F.row_number().over(Window.partitionBy(group).orderBy("first"))).drop("first")


def sku_summary(rows: DataFrame) -> DataFrame:
    """One row per SKU of all platforms' rows: NULL wherever a part is missing, never 0.

    rows: sku, position, product, price, quantity, value, nav (NULL where unknown). The unit price only
    where all rows have the same one; the value only where every row has one; nav is Conflict with
    several, N/A where one is missing.
    """
    out = rows.groupBy("sku").agg(
        F.array_join(first_seen(F.col("product"), F.col("position")), " | ").alias("product"),
        F.sum("quantity").alias("quantity"),
        F.when((F.count_if(F.col("price").isNull()) == 0) & (F.countDistinct("price") == 1), F.max("price")).alias("price"),
        F.when(F.count_if(F.col("value").isNull()) == 0, F.sum("value")).cast("decimal(28,2)").alias("value"),
        F.when(F.countDistinct("nav") > 1, "Conflict").when((F.count_if(F.col("nav").isNull()) > 0) | (F.countDistinct("nav") == 0), "N/A").otherwise(F.max("nav")).alias("nav"),
    )
    return out.withColumn("discount", (F.col("price") * F.col("quantity") - F.col("value")).cast("decimal(28,2)"))


def missing_sku_rows(rows: DataFrame) -> DataFrame:
    return rows.where(F.coalesce(F.trim("sku"), F.lit("")) == "")


def chosen_range(days: DataFrame, start: object, end: object) -> None:
    """Raises unless both ends are given, in order, and each is one of the days (column day)."""
    if start is None or end is None or start > end:
        raise ValueError("both ends of the range are needed, the first not after the last")
    known = {r["day"] for r in days.where(F.col("day").isin(start, end)).select("day").distinct().collect()}  # two rows at most
    if missing := {start, end} - known:
        raise ValueError(f"no such day: {sorted(map(str, missing))}")
