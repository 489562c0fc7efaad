"""Queries of invoice checks and of the lookup by exact name and variation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymill.operators import invoice_checks, products
from tallymill.plans import relations as r
from tallymill.plans.oracle import CANONICAL
from tallymill.plans.queries import query
from tallymill.sources import canonical as c


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Items of invoices by the master's price: some of a promotion, some with missing or broken fields."""
    key, line = F.col("order_id").cast("long"), F.col("item_index")
    whole = (F.col("unit_price") * F.col("quantity")).cast(r.MONEY)
    promoted = (F.col("flag") == "A") & (key % 3 == 0)
    rows = c.items(spark, d).join(c.master(spark, d).select("sku", "unit_price"), "sku").withColumn("whole", whole)
    group = F.sum("whole").over(Window.partitionBy("order_id", "flag")).cast(r.MONEY)
    return rows.select(
        "order_id",
        "item_index",
        F.when((key + line) % 17 == 0, " ").otherwise(F.concat(F.lit("Item "), "sku")).alias("name"),
        F.when((key % 19 == 0) & (line == 1), 0).otherwise(F.col("quantity")).alias("quantity"),
        F.when(F.col("flag") == "R", F.when(key % 4 == 0, (F.col("quantity") + 1).cast("string")).otherwise(r.cases(key, 4, {1: "0", 2: "x", 3: "1"}))).alias("refund_quantity"),
        F.when((key % 23 == 0) & (line == 0), "").otherwise(F.col("sku")).alias("sku"),
        (key % 46 == 0).alias("sku_missing_in_source"),
        F.col("unit_price").alias("price"),
        F.when((key + 2 * line) % 31 != 0, F.col("whole") + F.when((key + line) % 29 == 0, r.cents(5)).otherwise(r.cents(0))).cast(r.MONEY).alias("total"),
        F.when((key + line) % 58 == 0, "Any 3 at RM 10.00").alias("label"),
        F.when(promoted, F.concat("order_id", F.lit("/A"))).alias("promotion"),
        F.when(promoted & (key % 6 == 0), group).alias("group_total"),
        "whole",
    )


def _invoices(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(amounts of every invoice, its items); merchandise is off by three cents in one of eleven."""
    key = F.col("order_id").cast("long")
    items = _items(spark, d)
    refund = F.when(key % 8 == 1, r.cents(-100))
    sums = items.groupBy("order_id").agg(F.sum("whole").cast(r.MONEY).alias("whole"))
    rows = sums.select(
        "order_id",
        "whole",
        F.when(key % 5 != 0, F.col("whole")).alias("product_price"),
        refund.alias("refund"),
        F.when(key % 37 != 0, F.col("whole") + F.coalesce(refund, r.cents(0)) + F.when(key % 11 == 0, r.cents(3)).otherwise(r.cents(0))).cast(r.MONEY).alias("merchandise"),
    )
    return rows, items.drop("whole")


@query
def invoice_item_errors(spark: SparkSession, d: str) -> DataFrame:
    """Items by everything that is wrong with them."""
    rows = _items(spark, d).withColumn("errors", F.array_join(invoice_checks.item_errors(), ","))
    return rows.groupBy("errors").agg(F.count("*").alias("n_items"), F.countDistinct("order_id").alias("n_orders"))


@query
def invoice_product_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Invoices by the first of their product amounts that doesn't add up."""
    found = invoice_checks.product_amounts(*_invoices(spark, d))
    return found.groupBy("problem").agg(F.count("*").alias("n_orders"), F.sum("extracted").alias("extracted"), F.sum("n_totals").alias("n_totals"))


@query
def cancelled_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Cancelled orders, whose amounts must come to nothing."""
    key = F.col("order_id").cast("long")
    rows, items = _invoices(spark, d)
    zero = r.cents(0)
    gone = rows.join(c.orders(spark, d).where("status = 'Cancelled'").select("order_id"), "order_id", "left_semi").select(
        "order_id",
        F.col("whole").alias("product_price"),
        F.when(key % 4 == 1, F.col("whole")).when(key % 4 > 1, -F.col("whole")).cast(r.MONEY).alias("cancelled"),
        zero.alias("merchandise"),
        F.when(key % 3 == 0, r.cents(500)).otherwise(zero).alias("order_income"),
        F.when(key % 5 != 0, zero).alias("final_amount"),
    )
    return invoice_checks.cancelled_amounts(gone, items).groupBy("problem").agg(F.count("*").alias("n_orders"))


@query
def income_totals(spark: SparkSession, d: str) -> DataFrame:
    """Invoices by whether their written amounts make their income."""
    key = F.col("order_id").cast("long")
    rows, _ = _invoices(spark, d)
    parts = F.when(key % 3 == 0, r.cents(-100)).otherwise(r.cents(0)) + r.cents(-500)
    written = rows.select(
        "whole",
        F.when(key % 13 == 0, "abc").when(key % 17 == 0, " N/A").otherwise(F.concat(F.lit("RM "), F.format_number("whole", 2))).alias("merchandise"),
        F.col("whole").cast("string").alias("product_price"),
        (F.col("whole") + parts + F.when(key % 7 == 0, r.cents(4)).otherwise(r.cents(0))).cast("string").alias("order_income"),
        F.when(key % 3 == 0, "-1.00").otherwise("").alias("shipping"),
        F.when(key % 41 == 0, "x").otherwise("-5.00").alias("vouchers"),
        F.lit(None).cast("string").alias("fees"),
    )
    return written.groupBy(invoice_checks.income_problem().alias("problem")).agg(F.count("*").alias("n_orders"), F.sum("whole").alias("whole"))


@query
def exact_name_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Sold items looked up by exact name and variation, in which a SKU only narrows."""
    key, part = F.col("order_id").cast("long"), F.col("sku").cast("long")
    m = c.master(spark, d)
    records = m.select(part.alias("source_row"), F.when(part % 5 == 0, "S").otherwise(F.col("sku")).alias("sku"), F.col("parent").alias("name"), "variation")
    rows = c.items(spark, d).join(m, "sku").select(
        "order_id",
        F.when(key % 3 == 0, " S ").otherwise(F.col("sku")).alias("sku"),
        F.when(key % 31 == 0, " ").otherwise(F.concat(F.lit(" "), F.upper("parent"))).alias("name"),
        F.when(key % 4 == 0, "").otherwise(F.regexp_replace("variation", " ", "  ")).alias("variation"),
    )
    found = products.exact_name_lookup(rows, records)
    return found.groupBy("outcome").agg(F.count("*").alias("n_rows"), F.countDistinct("order_id").alias("n_orders"), F.sum("source_row").alias("source_rows"))


_INVOICE = """
, vi AS (SELECT i.order_id, i.key, item_index AS line, sku, i.quantity, flag, price_c, price_c * i.quantity AS w FROM items_c i JOIN master_c USING (sku, part)),
vt AS (SELECT *, CASE WHEN key % 19 = 0 AND line = 1 THEN 0 ELSE quantity END AS q, CASE WHEN (key + 2 * line) % 31 <> 0 THEN w + CASE WHEN (key + line) % 29 = 0 THEN 5 ELSE 0 END END AS total,
              flag = 'A' AND key % 6 = 0 AS grouped, sum(w) OVER (PARTITION BY order_id, flag) AS gw FROM vi),
vx AS (SELECT order_id, key, sum(w)::BIGINT AS whole, coalesce(sum(total) FILTER (NOT grouped AND q > 0), 0) + coalesce(max(gw) FILTER (grouped), 0) AS ext,
              count(total) FILTER (NOT grouped AND q > 0) + CASE WHEN bool_or(grouped) THEN 1 ELSE 0 END AS n,
              coalesce(bool_or(NOT grouped AND q > 0 AND total IS NOT NULL AND (key + line) % 29 = 0 AND (key + line) % 58 <> 0), false) AS wrong FROM vt GROUP BY ALL)
"""
BODIES = {
    "invoice_item_errors": _INVOICE + """
, e AS (SELECT order_id, concat_ws(',', CASE WHEN (key + line) % 17 = 0 THEN 'MISSING_NAME' END, CASE WHEN q <= 0 THEN 'INVALID_QUANTITY' END, CASE WHEN flag = 'R' AND key % 4 IN (1, 2) THEN 'INVALID_REFUND_QUANTITY' END,
          CASE WHEN flag = 'R' AND q > 0 AND key % 4 = 0 THEN 'REFUND_EXCEEDS_QUANTITY' END, CASE WHEN key % 23 = 0 AND line = 0 AND key % 46 <> 0 THEN 'MISSING_SKU' END, CASE WHEN total IS NULL AND NOT grouped THEN 'MISSING_TOTAL' END) AS errors FROM vt)
SELECT errors, count(*) AS n_items, count(DISTINCT order_id) AS n_orders FROM e GROUP BY errors""",
    "invoice_product_amounts": _INVOICE + """
, p AS (SELECT *, CASE WHEN wrong THEN 'ITEM_TOTAL' WHEN key % 37 = 0 OR n = 0 THEN NULL WHEN key % 5 <> 0 AND abs(ext - whole) > 2 THEN 'PRODUCT_PRICE'
               WHEN abs(CASE WHEN key % 5 <> 0 THEN whole ELSE ext END - whole - CASE WHEN key % 11 = 0 THEN 3 ELSE 0 END) > 2 THEN 'MERCHANDISE' END AS problem FROM vx)
SELECT problem, count(*) AS n_orders, sum(ext) / 100.0 AS extracted, sum(n)::BIGINT AS n_totals FROM p GROUP BY problem""",
    "cancelled_amounts": _INVOICE + """
, p AS (SELECT CASE WHEN vx.key % 4 = 0 THEN 'CANCELLED_MISSING' WHEN vx.key % 4 = 1 THEN 'CANCELLED_NOT_NEGATIVE' WHEN wrong THEN 'ITEM_TOTAL' WHEN n > 0 AND abs(ext - whole) > 2 THEN 'PRODUCT_PRICE'
               WHEN vx.key % 3 = 0 THEN 'ORDER_INCOME_NOT_ZERO' WHEN vx.key % 5 = 0 THEN 'FINAL_AMOUNT_MISSING' END AS problem FROM vx JOIN orders_c USING (order_id) WHERE status = 'Cancelled')
SELECT problem, count(*) AS n_orders FROM p GROUP BY problem""",
    "income_totals": _INVOICE + """
SELECT CASE WHEN key % 13 = 0 THEN 'MERCHANDISE_NOT_NUMERIC' WHEN key % 17 = 0 THEN NULL WHEN key % 41 = 0 THEN 'VOUCHERS_NOT_NUMERIC' WHEN key % 7 = 0 THEN 'INCOME_TOTAL' END AS problem, count(*) AS n_orders, sum(whole) / 100.0 AS whole FROM vx GROUP BY 1""",
    "exact_name_lookup": """
, er AS (SELECT part, CASE WHEN part % 5 = 0 THEN 'S' ELSE sku END AS sku, parent, variation FROM master_c),
en AS (SELECT parent, variation, count(*) AS n, min(part) AS p FROM er GROUP BY ALL), es AS (SELECT parent, variation, sku, count(*) AS n, min(part) AS p FROM er GROUP BY ALL),
x AS (SELECT order_id, key, CASE WHEN key % 3 = 0 THEN 'S' ELSE sku END AS sku, parent, CASE WHEN key % 4 = 0 THEN '' ELSE variation END AS variation FROM items_c JOIN master_c USING (sku, part)),
y AS (SELECT order_id, CASE WHEN key % 31 = 0 OR en.n IS NULL THEN 'NOT_FOUND' WHEN en.n = 1 THEN 'MATCHED_BY_NAME_VARIATION' WHEN es.n = 1 THEN 'MATCHED_BY_SKU_NAME_VARIATION' ELSE 'CONFLICT' END AS outcome, en.p AS p1, es.p AS p2
      FROM x LEFT JOIN en ON en.parent = x.parent AND en.variation = x.variation LEFT JOIN es ON es.parent = x.parent AND es.variation = x.variation AND es.sku = x.sku)
SELECT outcome, count(*) AS n_rows, count(DISTINCT order_id) AS n_orders, sum(CASE outcome WHEN 'MATCHED_BY_NAME_VARIATION' THEN p1 WHEN 'MATCHED_BY_SKU_NAME_VARIATION' THEN p2 END)::BIGINT AS source_rows FROM y GROUP BY outcome""",
}

SQL = {name: CANONICAL + body for name, body in BODIES.items()}
