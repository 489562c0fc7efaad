"""Further relations for the queries, from the supplied tables by rules on their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymill.functions.text import statement_name
from tallymill.operators.reconciliation import keyed
from tallymill.sources import canonical as c
from tallymill.sources.stored import stored

MONEY = c.MONEY


def cases(key: Column, modulus: int, values: dict[int, str]) -> Column:
    out = F.lit(None).cast("string")
    for rest, value in values.items():
        out = F.when(key % modulus == rest, value).otherwise(out)
    return out


def cents(n: int) -> Column:
    return F.lit(f"{n / 100:.2f}").cast(MONEY)


def invoices(spark: SparkSession, d: str) -> DataFrame:
    """order_id, market, created, status, income_type, final_amount, order_income, payment_status, transferred_on, released_on, refund."""
    key = F.col("order_id").cast("long")
    total = F.col("product") + F.col("discount") + F.col("fee") + F.coalesce("refund", F.lit(0).cast(MONEY))
    rows = c.orders(spark, d).drop("final_amount").join(c.ledger(spark, d), "order_id", "left")
    return rows.select(
        "order_id",
        "market",
        "created",
        "status",
        cases(key, 4, {0: "Final", 1: "Estimated", 2: " final"}).alias("income_type"),
        F.when(key % 5 != 0, total + F.when(key % 13 == 0, cents(5)).otherwise(cents(0))).cast(MONEY).alias("final_amount"),
        F.when(key % 15 != 0, total).cast(MONEY).alias("order_income"),
        cases(key, 6, {0: "Pending", 1: "RELEASED", 2: " released ", 3: "pending", 5: "N/A"}).alias("payment_status"),
        F.when(key % 9 < 3, F.date_add("created", 10)).alias("transferred_on"),
        F.when(F.col("released").isNotNull(), F.col("payout")).alias("released_on"),
        F.when(key % 8 == 1, F.col("refund") - cents(100)).otherwise(F.col("refund")).cast(MONEY).alias("refund"),
    )


def income_rows(spark: SparkSession, d: str) -> DataFrame:
    """order_id, view_by, payout, released, refund: a statement's income rows, some repeated, some broken."""
    key = F.col("order_id").cast("long")
    rows = c.ledger(spark, d).where("released IS NOT NULL")
    row = lambda view, released: F.struct(F.lit(view).alias("view_by"), "payout", released.cast(MONEY).alias("released"), "refund")
    own = F.array_compact(F.array(
        row("Order", F.when(key % 14 != 3, F.col("released"))),
        F.when(key % 12 < 2, row("Order", F.col("released") + F.when(key % 12 == 1, cents(1)).otherwise(cents(0)))),
        F.when(key % 50 == 7, row("Other", F.col("released"))),
    ))
    skus = c.items(spark, d).select("order_id", F.lit("Sku").alias("view_by"), F.col("shipped").alias("payout"), F.col("subtotal").alias("released"), F.lit(None).cast(MONEY).alias("refund"))
    return rows.select("order_id", F.inline(own)).unionByName(skus)


def platform_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders of several platforms, with amounts as text: with marks and separators, blank or N/A."""
    key = F.col("order_id").cast("long")
    written = F.concat(F.lit("RM "), F.format_number("final_amount", 2))
    return c.orders(spark, d).select(
        cases(key, 5, {0: "Shopee", 1: "Shopee SG", 2: " Lazada", 3: "ZENXIN", 4: "Other"}).alias("platform"),
        "order_id",
        F.when(key % 9 == 0, "N/A").when(key % 9 != 1, written).otherwise("").alias("order_income"),
        F.when(key % 8 != 0, written).alias("net_paid"),
        F.format_number("final_amount", 2).alias("total"),
        F.when(key % 7 == 0, " none").otherwise(written).alias("final_amount"),
        written.alias("gross_sales"),
        F.when(key % 7 == 0, "").otherwise("12.50").alias("platform_fees"),
        F.when(key % 3 == 0, "-5.00").alias("voucher"),
        F.concat(F.lit("S$"), F.format_number("final_amount", 2)).alias("net_amount"),
    )


def platform_products(spark: SparkSession, d: str) -> DataFrame:
    """platform, order_id, product, price, quantity of the platforms' orders; some are blank or broken."""
    key = F.col("order_id").cast("long")
    rows = c.items(spark, d).join(c.master(spark, d), "sku", "left")
    return rows.select(
        cases(key, 5, {0: "Shopee", 1: "Shopee SG", 2: " Lazada", 3: "ZENXIN", 4: "Other"}).alias("platform"),
        "order_id",
        "item_index",
        "sku",
        F.when(key % 31 == 0, " N/A").otherwise(F.col("product")).alias("product"),
        F.when(key % 37 == 0, "free").otherwise(F.concat(F.lit("RM "), F.col("unit_price").cast("string"))).alias("price"),
        F.when(key % 41 == 0, "none").otherwise(F.concat(F.col("quantity").cast("string"), F.lit(" pcs"))).alias("quantity"),
        "subtotal",
    )


def adjustment_events(spark: SparkSession, d: str) -> DataFrame:
    """order_id, fingerprint, amount, statement_hash of the adjustments; those of every fifth order come to nothing."""
    nothing = F.col("order_id").cast("long") % 5 == 1
    hashed = F.concat(F.lit("h"), (F.col("event_id") % 3).cast("string"))
    return c.adjustments(spark, d).select("order_id", F.col("event_id").cast("string").alias("fingerprint"), F.when(nothing, cents(0)).otherwise(F.col("amount")).alias("amount"), hashed.alias("statement_hash"))


def ean13(key: Column) -> Column:
    """A valid EAN-13 from a number."""
    twelve = F.lpad(key.cast("string"), 12, "0")
    total = F.aggregate(F.transform(F.split(twelve, ""), lambda x, i: x.cast("int") * F.when(i % 2 == 0, 1).otherwise(3)), F.lit(0), lambda acc, x: acc + x)
    return F.concat(twelve, ((10 - total % 10) % 10).cast("string"))


def listings(spark: SparkSession, d: str) -> DataFrame:
    """sku, listing (its resolve text), seller_sku, raw_name, raw_variation, product, variation, unit_price, parent."""
    key, code = F.col("sku").cast("long"), ean13(F.col("sku"))
    listing = (
        F.when(key % 8 == 0, F.concat(F.lit("nav: N"), "sku", F.lit("-3")))
        .when(key % 8 == 1, F.concat(code, F.lit("-2")))
        .when(key % 8 == 2, F.concat(code, F.lit("-box")))
        .when(key % 8 == 3, F.concat(F.lit("CODE"), "sku"))
        .when(key % 8 == 4, F.concat(code, F.lit("; NAV:X"), "sku", F.lit(" ;")))
        .when(key % 8 == 5, F.concat(code, F.lit("-0")))
        .when(key % 8 == 6, " ")
    )
    seller = F.when(key % 4 == 0, code).when(key % 4 == 1, F.concat(code, F.lit("-"), (key % 5).cast("string"))).when(key % 4 == 2, F.concat(F.lit(" S"), "sku")).otherwise(F.concat(F.lit("-"), "sku"))
    name = F.concat(F.when(key % 5 == 0, "Pre-Order F ree ").otherwise(""), F.regexp_replace("product", " ", "  "), F.when(key % 3 == 0, F.concat(F.lit("  variation : "), "variation")).when(key % 3 == 1, " & Co").otherwise(""))
    variation = F.when(key % 3 == 0, "").otherwise(F.concat(F.when(key % 6 == 1, "Variation: ").otherwise(""), F.col("variation"), F.when(key % 4 == 0, F.concat(F.lit(" RM "), F.format_number("unit_price", 2))).when(key % 4 == 1, " 1.00").otherwise("")))
    return c.master(spark, d).select("*", listing.alias("listing"), seller.alias("seller_sku"), name.alias("raw_name"), variation.alias("raw_variation"))


def statement_rows(spark: SparkSession, d: str) -> DataFrame:
    """A statement's order rows by batch (the week of the payout), with the batch's declared facts on every row.

    batch_id, file_hash, period_from, period_to, order_count, order_id, validation, commit, payout, released.
    """
    key = F.col("order_id").cast("long")
    week = F.date_trunc("week", "payout").cast("date")
    rows = c.ledger(spark, d).where("released IS NOT NULL").select("order_id", week.alias("period_from"), "payout", "released", F.when(key % 23 == 0, "PENDING").otherwise("COMMITTED").alias("commit"), F.when(key % 29 == 0, "FAILED").otherwise("PASSED").alias("validation"))
    counts = rows.where("commit = 'COMMITTED'").groupBy("period_from").agg(F.count("*").alias("n"))
    number = F.datediff("period_from", F.lit("1990-01-01").cast("date"))
    return rows.join(counts, "period_from", "left").select(
        F.concat(F.lit("b"), number.cast("string")).alias("batch_id"),
        F.when((number % 11 == 0) & (key % 2 == 0), F.lit("other")).otherwise(F.concat(F.lit("h"), number.cast("string"))).alias("file_hash"),
        "period_from",
        F.date_add("period_from", 6).alias("period_to"),
        (F.coalesce("n", F.lit(0)) + F.when(number % 13 == 0, 1).otherwise(0)).alias("order_count"),
        "order_id",
        "validation",
        "commit",
        "payout",
        "released",
    )


def family_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(statement rows, order items, product families) as `operators.reconciliation` takes them, rows and items with their keys; both
    are views of one stored table, so the items are read, keyed and written once.

    40 listings in twelve families stand for the parts. Some items have no SKU, some listings only a parent SKU, some
    belong to two families, some don't agree with their items' NAV; names on the statement are as in the order, in
    other case, or of another product, and some orders show a renamed product. The first line of each twelfth
    order has no row, and some rows a product that is in no family.
    """
    key, line, part = F.col("order_id").cast("long"), F.col("item_index"), F.col("sku").cast("long")
    listing = part % 40
    family, text = listing % 12, lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    promoted = (F.col("flag") == "R") & (key % 2 == 0)
    both = c.items(spark, d).select(
        "order_id",
        "item_index",
        F.when(part % 9 != 0, text("S", listing)).otherwise("").alias("sku"),
        F.when((key + line) % 11 == 0, text("Renamed ", family)).otherwise(text("Item ", family)).alias("name"),
        text("V", F.floor(listing / 12)).alias("variation"),
        text("N", listing).alias("nav"),
        F.when(key % 20 != 3, F.col("quantity")).alias("quantity"),
        (listing + 10).cast(MONEY).alias("unit_price"),
        "subtotal",
        F.when(promoted, F.concat("order_id", F.lit("/R"))).alias("promotion"),
        F.when(promoted, "Buy more").alias("label"),
        F.when(promoted & (key % 16 != 6), F.sum(F.when(F.col("flag") == "R", F.col("subtotal"))).over(Window.partitionBy("order_id"))).cast(MONEY).alias("group_total"),
        text("P", family).alias("product_id"),
        F.when((key + line) % 7 == 0, text("other Item ", family)).when((key + line) % 3 == 0, text("ITEM  ", family)).otherwise(text("Item ", family)).alias("stated"),
    )
    both = stored(keyed(both).withColumn("stated_key", statement_name(F.col("stated"))), "family-rows", "order_id")
    rows = both.where((key % 12 != 5) | (line != 0)).select(
        "order_id",
        F.col("item_index").alias("row_no"),
        F.when((key % 17 == 0) & (line == 1), "PX").otherwise(F.col("product_id")).alias("product_id"),
        F.col("stated").alias("name"),
        F.col("stated_key").alias("name_key"),
        (F.col("subtotal") + F.when(key % 10 == 3, cents(3)).otherwise(cents(0))).cast(MONEY).alias("price"),
    )
    listed = c.master(spark, d).select(listing.alias("listing")).distinct()
    n = F.col("listing")
    in_families = F.explode(F.when(n % 10 == 7, F.array(n % 12, (n + 1) % 12)).otherwise(F.array(n % 12)))
    families = listed.select("listing", in_families.alias("family")).select(
        text("P", F.col("family")).alias("product_id"),
        F.when(n % 5 == 4, text("M", n)).otherwise(text("S", n)).alias("sku"),
        F.when(n % 5 == 4, text("S", n)).otherwise(text("K", n % 12)).alias("parent_sku"),
        text("Item ", n % 12).alias("name"),
        text("V", F.floor(n / 12)).alias("variation"),
        F.when(n % 13 == 5, "X").otherwise(text("N", n)).alias("nav"),
        (n + 10).cast(MONEY).alias("price"),
    )
    return rows, both.drop("product_id", "stated", "stated_key"), families
