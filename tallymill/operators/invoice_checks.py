"""Checks of single invoices: their items, the items' amounts, their income and cancellations.

Every check names the first thing that is wrong, NULL if nothing is; a check whose amounts are missing
says nothing. Amounts are equal within the tolerance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
TOLERANCE = "0.02"
#: The wording of a promotion that explains a total, and the income's optional parts.
PROMOTION = r"(?i)\bAny\s+\d+\s+(?:at\s+RM\s*[\d,]+(?:\.\d+)?|enjoy\s+[\d,]+(?:\.\d+)?\s*%\s*off)"
REQUIRED = ("merchandise", "product_price", "order_income")
OPTIONAL = ("shipping", "vouchers", "fees")


def _blank(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")) == ""


def _off(left: Column, right: Column) -> Column:
    return F.abs(left - right) > F.lit(TOLERANCE).cast(MONEY)


def item_errors(require_sku: bool = True, require_total: bool = True) -> Column:
    """What is wrong with an item, in a fixed order; an empty array if nothing.

    Columns: name, quantity, refund_quantity (text), sku, sku_missing_in_source, total, promotion, group_total.
    """
    refunded = F.trim("refund_quantity").try_cast("long")
    stated = F.col("refund_quantity").isNotNull()
    whole = F.coalesce((refunded > 0) & (F.trim("refund_quantity") == refunded.cast("string")), F.lit(False))
    of_group = ~_blank(F.col("promotion")) & F.col("group_total").isNotNull()
    quantity = F.coalesce("quantity", F.lit(0))
    return F.array_compact(
        F.array(
            F.when(_blank(F.col("name")), "MISSING_NAME"),
            F.when(quantity <= 0, "INVALID_QUANTITY"),
            F.when(stated & ~whole, "INVALID_REFUND_QUANTITY"),
            F.when(stated & whole & (quantity > 0) & (refunded > quantity), "REFUND_EXCEEDS_QUANTITY"),
            F.when(F.lit(require_sku) & _blank(F.col("sku")) & ~F.coalesce("sku_missing_in_source", F.lit(False)), "MISSING_SKU"),
            F.when(F.lit(require_total) & F.col("total").isNull() & ~of_group, "MISSING_TOTAL"),
        )
    )


def item_totals(items: DataFrame) -> DataFrame:
    """Per order: the sum of its items' totals, how many there are, and the first item whose total isn't price x quantity.

    items: order_id, item_index, quantity, price, total, label, promotion, group_total. A promotion with
    a total counts once, by that of its first item; its items' own totals don't count.
    """
    grouped = ~_blank(F.col("promotion")) & F.col("group_total").isNotNull()
    line = F.when(~grouped & F.col("price").isNotNull() & (F.col("quantity") > 0), F.col("total"))
    explained = F.coalesce(F.col("label").rlike(PROMOTION), F.lit(False))
    wrong = line.isNotNull() & _off(F.col("price") * F.col("quantity"), F.col("total")) & ~explained
    groups = items.groupBy("order_id", F.when(grouped, F.trim("promotion")).alias("_group")).agg(
        F.sum(line).alias("_lines"),
        F.count(line).alias("_n"),
        F.min_by(F.when(grouped, F.col("group_total")), F.when(grouped, F.col("item_index"))).alias("_once"),
        F.min(F.when(wrong, F.col("item_index"))).alias("_wrong"),
    )
    nothing = F.lit(0).cast(MONEY)
    return groups.groupBy("order_id").agg(
        F.sum(F.coalesce("_lines", nothing) + F.coalesce("_once", nothing)).cast("decimal(28,2)").alias("extracted"),
        F.sum(F.col("_n") + F.when(F.col("_once").isNotNull(), 1).otherwise(0)).alias("n_totals"),
        F.min("_wrong").alias("first_wrong"),
    )


def _product_problem(refund: Column) -> Column:
    extracted = F.col("extracted")
    said = F.col("merchandise").isNotNull() & (F.coalesce("n_totals", F.lit(0)) > 0)
    base = F.coalesce(F.col("product_price"), extracted) + F.coalesce(refund, F.lit(0).cast(MONEY))
    return (
        F.when(F.col("first_wrong").isNotNull(), "ITEM_TOTAL")
        .when(said & F.coalesce(_off(extracted, F.col("product_price")), F.lit(False)), "PRODUCT_PRICE")
        .when(said & _off(base, F.col("merchandise")), "MERCHANDISE")
    )


def product_amounts(invoices: DataFrame, items: DataFrame) -> DataFrame:
    """invoices (order_id, merchandise, product_price, refund) with ``problem``: ITEM_TOTAL, PRODUCT_PRICE or MERCHANDISE."""
    return invoices.join(item_totals(items), "order_id", "left").withColumn("problem", _product_problem(F.col("refund")))


def cancelled_amounts(invoices: DataFrame, items: DataFrame) -> DataFrame:
    """Cancelled orders (with cancelled, order_income, final_amount too): a negative amount takes all back, the rest is 0."""
    problem = F.when(F.col("cancelled").isNull(), "CANCELLED_MISSING").when(F.col("cancelled") >= 0, "CANCELLED_NOT_NEGATIVE")
    zeros = []
    for name in ("merchandise", "order_income", "final_amount"):
        zeros.append(F.when(F.col(name).isNull(), f"{name.upper()}_MISSING").when(_off(F.col(name), F.lit(0).cast(MONEY)), f"{name.upper()}_NOT_ZERO"))
    return invoices.join(item_totals(items), "order_id", "left").withColumn("problem", F.coalesce(problem, _product_problem(F.col("cancelled")), *zeros))


def _missing(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")).isin("", "N/A")


def _amount(text: Column) -> Column:
    return F.when(~_missing(text), F.trim(F.regexp_replace(text, "RM|,", "")).try_cast(MONEY))


def income_problem() -> Column:
    """What is wrong with a normal order's income, whose amounts are text: <FIELD>_NOT_NUMERIC or INCOME_TOTAL.

    Merchandise and what there is of shipping, vouchers and fees make the order income.
    """
    unread = lambda name: F.when(~_missing(F.col(name)) & _amount(F.col(name)).isNull(), f"{name.upper()}_NOT_NUMERIC")
    complete = reduce(lambda a, b: a & b, (_amount(F.col(n)).isNotNull() for n in REQUIRED))
    parts = reduce(lambda a, b: a + b, (F.coalesce(_amount(F.col(n)), F.lit(0).cast(MONEY)) for n in OPTIONAL), _amount(F.col("merchandise")))
    total = F.when(_off(parts, _amount(F.col("order_income"))), "INCOME_TOTAL")
    return F.coalesce(*(unread(n) for n in REQUIRED), F.when(complete, F.coalesce(*(unread(n) for n in OPTIONAL), total)))
