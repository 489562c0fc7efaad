"""The canonical relations, as views of the supplied tables.

Money is decimal(18,2) from here on; identifiers are text. Doubles become cents by
floor(100 x + 0.5), the same in any engine. Line items have no key, so an item's place in its order
is its rank by the whole row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
STATUS = {"F": "Completed", "O": "To Ship", "P": "Cancelled"}


def money(value: Column) -> Column:
    """A double as exact money."""
    return (F.floor(value * 100 + 0.5).cast("decimal(18,0)") / F.lit(100).cast("decimal(3,0)")).cast(MONEY)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """market, order_id, status, created, final_amount."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_nationkey") % 2 == 0, "MY").otherwise("SG").alias("market"))
    status = F.when(F.col("o_orderstatus") == "F", STATUS["F"]).when(F.col("o_orderstatus") == "O", STATUS["O"]).otherwise(STATUS["P"])
    return (
        table(spark, sf_dir, "orders")
        .join(customer, "o_custkey")
        .select("market", F.col("o_orderkey").cast("string").alias("order_id"), status.alias("status"), F.to_date("o_orderdate").alias("created"), money(F.col("o_totalprice")).alias("final_amount"))
    )


ITEM_RANK = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_id, item_index, sku, quantity, original, subtotal, fee, flag, shipped.

    Ranked within order_id, as it is called from here on, so that what follows by order needs no further shuffle.
    """
    rank = F.row_number().over(Window.partitionBy("order_id").orderBy(*ITEM_RANK)) - 1
    original = money(F.col("l_extendedprice"))
    percent = F.floor(F.col("l_discount") * 100 + 0.5).cast("decimal(3,0)")
    tax = F.floor(F.col("l_tax") * 100 + 0.5).cast("decimal(3,0)")
    part = lambda amount, share: F.bround(amount * share / 100, 2).cast(MONEY)
    return (
        table(spark, sf_dir, "lineitem")
        .withColumn("order_id", F.col("l_orderkey").cast("string"))
        .select("order_id", rank.alias("item_index"), F.col("l_partkey").cast("string").alias("sku"), F.col("l_quantity").cast("int").alias("quantity"), original.alias("original"), part(original, 100 - percent).alias("subtotal"), tax.alias("_tax"), F.col("l_returnflag").alias("flag"), F.to_date("l_shipdate").alias("shipped"))
        .withColumn("fee", part(F.col("subtotal"), F.col("_tax")))
        .drop("_tax")
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with items: what a statement says of it, from one aggregation of the items.

    order_id, product, discount, fee, refund (NULL without one), payout, components (array of name and
    amount), released (NULL without a statement).

    Every seventh order has no statement, one in seven is off by three cents and one by two.
    """
    refunded = (F.col("flag") == "R") & (F.col("quantity") >= 40)
    sums = items(spark, sf_dir).groupBy("order_id").agg(
        F.sum("original").cast(MONEY).alias("product"),
        (-F.sum(F.col("original") - F.col("subtotal"))).cast(MONEY).alias("discount"),
        (-F.sum("fee")).cast(MONEY).alias("fee"),
        (-F.sum(F.when(refunded, F.col("subtotal")))).cast(MONEY).alias("refund"),
        F.max("shipped").alias("payout"),
    )
    named = [F.struct(F.lit(n).alias("name"), F.col(c).alias("amount")) for n, c in (("Product Price", "product"), ("Discount", "discount"), ("Transaction Fee", "fee"), ("Refund Amount", "refund"))]
    key = F.col("order_id").cast("long") % 7
    off = F.when(key == 0, F.lit("0.03")).when(key == 1, F.lit("0.02")).otherwise(F.lit("0.00")).cast(MONEY)
    total = F.col("product") + F.col("discount") + F.col("fee") + F.coalesce("refund", F.lit(0).cast(MONEY))
    return sums.withColumns({"components": F.filter(F.array(*named), lambda x: x["amount"].isNotNull()), "released": F.when(key != 2, (total + off).cast(MONEY))})


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_id, name, amount: what a statement says of an order, at order grain."""
    return ledger(spark, sf_dir).select("order_id", F.inline("components"))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_id, released, payout: the amount paid out of the orders that have a statement."""
    return ledger(spark, sf_dir).where("released IS NOT NULL").select("order_id", "released", "payout")


def adjustments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, order_id, kind, day, amount: single events that may belong to an order."""
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("order_id"), F.col("event_type").alias("kind"), F.to_date("ts").alias("day"), money(F.col("value")).alias("amount"))


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sku, parent, product, variation, unit_price."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("sku"), F.col("p_brand").alias("parent"), F.col("p_name").alias("product"), F.col("p_type").alias("variation"), money(F.col("p_retailprice")).alias("unit_price"))
