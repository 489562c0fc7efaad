"""Dashboard figures over accepted orders and products, whose amounts are text as the sources wrote them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.functions import casts

MONEY = "decimal(18,2)"
#: Where each platform's rows have their income; others have none.
INCOME_FIELD = {"Shopee": "order_income", "Shopee SG": "order_income", "Lazada": "net_paid", "ZENXIN": "total"}


def income() -> Column:
    """The order's income by its platform's own column; NULL for unknown platforms."""
    out = F.lit(None).cast(MONEY)
    for platform, column in INCOME_FIELD.items():
        out = F.when(F.trim("platform") == platform, casts.lenient_money(F.col(column))).otherwise(out)
    return out


def _or_zero(amount: Column) -> Column:
    return F.coalesce(F.sum(amount), F.lit(0)).cast("decimal(28,2)")


def _product_counts(products: DataFrame, keys: list[str]) -> DataFrame:
    rows = products.withColumn("_quantity", casts.lenient_quantity(F.col("quantity")))
    return rows.groupBy(keys).agg(F.count("*").alias("n_products"), F.sum("_quantity").alias("quantity"))


def overall(orders: DataFrame, products: DataFrame, sources: DataFrame) -> DataFrame:
    """One row: sources, orders, product rows, quantity and income of all platforms."""
    own = orders.agg(F.count("*").alias("n_orders"), _or_zero(income()).alias("income"))
    counted = _product_counts(products, []).select("n_products", F.coalesce("quantity", F.lit(0)).alias("quantity"))
    return own.join(F.broadcast(counted)).join(F.broadcast(sources.agg(F.count("*").alias("n_sources"))))  # one row each


def by_platform(orders: DataFrame, products: DataFrame) -> DataFrame:
    """Per platform: orders, product rows, quantity, income, gross sales, fees (with vouchers) and net amount."""
    money = lambda c: _or_zero(casts.lenient_money(F.col(c)))
    own = orders.groupBy("platform").agg(F.count("*").alias("n_orders"), _or_zero(income()).alias("income"), money("gross_sales").alias("gross_sales"), (money("platform_fees") + money("voucher")).cast("decimal(28,2)").alias("fees"), money("net_amount").alias("net_amount"))
    return own.join(_product_counts(products, ["platform"]), "platform", "left").fillna(0, ["n_products", "quantity"])


def validation(orders: DataFrame, products: DataFrame) -> DataFrame:
    """One row of the accepted batch: income and final amount apart, over present values only."""
    money = lambda c: _or_zero(casts.present_money(F.col(c)))
    own = orders.agg(F.count("*").alias("n_orders"), money("order_income").alias("order_income"), money("final_amount").alias("final_amount"), F.count(casts.present_money(F.col("final_amount"))).alias("n_final"))
    return own.join(F.broadcast(_product_counts(products, [])))  # one row each


def status_shares(rows: DataFrame) -> DataFrame:
    """Three statuses of reconciled orders with their share of the sum of the three."""
    names = {"RECONCILED": "Reconciled", "MISSING_STATEMENT": "Pending statement", "MISMATCH": "Mismatch"}
    counts = rows.agg(*(F.count_if(F.col("state") == s).alias(n) for s, n in names.items()))
    total = sum((F.col(f"`{n}`") for n in list(names.values())[1:]), F.col("`Reconciled`"))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("status"), F.col(f"`{n}`").alias("n_orders"), total.alias("total")) for n in names.values())))
    return counts.select(each.alias("x")).select("x.status", "x.n_orders", F.when(F.col("x.total") > 0, F.col("x.n_orders") / F.col("x.total")).otherwise(0.0).alias("share"))


def outcomes(uploads: DataFrame) -> DataFrame:
    """Uploads of each action by what became of them; an unknown outcome is an error."""
    kinds = ("imported", "review", "duplicate", "unsupported")
    known = F.col("outcome").isin(*kinds)
    return uploads.groupBy("action").agg(F.count("*").alias("n_processed"), *(F.count_if(F.col("outcome") == k).alias(f"n_{k}") for k in kinds), F.count_if(~F.coalesce(known, F.lit(False))).alias("n_error"))
