"""Queries of settlement reporting, dashboards, names and codes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.functions import casts, text
from tallymill.operators import dashboards, products, settlement
from tallymill.plans import relations as r
from tallymill.plans.oracle import CANONICAL, INVOICES
from tallymill.plans.queries import _reconciled, query
from tallymill.sources import canonical as c


def _reporting(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    orders, income = r.invoices(spark, d), r.income_rows(spark, d)
    return settlement.reporting(orders, income), income, orders


@query
def settlement_reporting(spark: SparkSession, d: str) -> DataFrame:
    """Orders by settlement decision, refund check, readiness, comparison and transition."""
    rows, _, _ = _reporting(spark, d)
    return rows.groupBy("settlement", "refund_validation", "ready", F.col("compared.source").alias("source"), F.col("compared.status").alias("comparison"), "transition", "effective_payment").agg(F.count("*").alias("n_orders"), F.sum("compared.difference").alias("difference"))


@query
def settlement_summary(spark: SparkSession, d: str) -> DataFrame:
    """The counters of the settlement report."""
    return settlement.reporting_summary(*_reporting(spark, d))


def _proved(spark: SparkSession, d: str) -> DataFrame:
    orders = r.invoices(spark, d).withColumn("statement_hash", F.concat(F.lit("h"), (F.col("order_id").cast("long") % 3).cast("string")))
    return settlement.adjustment_proof(orders, r.adjustment_events(spark, d))


@query
def adjustment_proofs(spark: SparkSession, d: str) -> DataFrame:
    """Orders with linked adjustments by how these explain the final amount."""
    rows = _proved(spark, d).where("n_cross IS NOT NULL")
    return rows.groupBy("proof").agg(F.count("*").alias("n_orders"), F.sum("cross_total").alias("cross_total"), F.sum("current_total").alias("current_total"))


@query
def order_waterfalls(spark: SparkSession, d: str) -> DataFrame:
    """Orders by settlement basis: statement components against the invoice's, with what explains the difference."""
    key, zero = F.col("order_id").cast("long"), F.lit(0).cast(r.MONEY)
    side = c.ledger(spark, d).where("released IS NOT NULL").select("order_id", F.col("product").alias("s_merchandise"), F.when(key % 17 != 0, F.coalesce("refund", zero)).alias("s_refund"), zero.alias("s_shipping"), F.col("discount").alias("s_voucher_rebate"), F.col("fee").alias("s_fees"))
    rows = _proved(spark, d).join(side, "order_id")
    rows = rows.withColumns(
        {
            "layout": F.when(key % 3 != 0, "NORMAL_ORDER").otherwise("RETURN_REFUND"),
            "i_merchandise": F.when(key % 10 == 1, F.col("s_merchandise") - r.cents(50)).otherwise(F.col("s_merchandise")).cast(r.MONEY),
            "i_refund": F.when(key % 16 != 5, F.col("refund")),
            "i_shipping": F.lit(None).cast(r.MONEY),
            "i_voucher_rebate": F.col("s_voucher_rebate"),
            "i_fees": F.when(key % 19 != 0, F.col("s_fees")),
            "order_income": F.when(key % 10 == 1, F.col("order_income") - r.cents(50)).otherwise(F.col("order_income")).cast(r.MONEY),
            "final_amount": F.when(key % 10 == 1, None).otherwise(F.col("final_amount")),
        }
    )
    out = settlement.waterfall(rows)
    return out.groupBy("basis", "late_refund", "proof").agg(F.count("*").alias("n_orders"), F.sum("statement_total").alias("statement_total"), F.sum("raw_difference").alias("raw_difference"), F.sum("explained_delta").alias("explained_delta"), F.sum("residual").alias("residual"))


@query
def overall_dashboard(spark: SparkSession, d: str) -> DataFrame:
    return dashboards.overall(r.platform_orders(spark, d), r.platform_products(spark, d), c.statements(spark, d).select("payout").distinct())


@query
def platform_dashboards(spark: SparkSession, d: str) -> DataFrame:
    return dashboards.by_platform(r.platform_orders(spark, d), r.platform_products(spark, d))


@query
def validation_dashboard(spark: SparkSession, d: str) -> DataFrame:
    return dashboards.validation(r.platform_orders(spark, d), r.platform_products(spark, d))


@query
def reconciliation_status(spark: SparkSession, d: str) -> DataFrame:
    return dashboards.status_shares(_reconciled(spark, d))


@query
def upload_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Events as uploads: by kind, what became of each."""
    rows = c.adjustments(spark, d).select(F.col("kind").alias("action"), r.cases(F.col("event_id"), 6, {0: "imported", 1: "review", 2: "duplicate", 3: "unsupported", 4: "imported"}).alias("outcome"))
    return dashboards.outcomes(rows)


@query
def review_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Product rows by the reasons that send them to review, in their fixed order."""
    rows = r.platform_products(spark, d)
    missing = F.lower(F.coalesce(F.trim("product"), F.lit(""))).isin("", "n/a")
    price = casts.strict_price(F.col("price"))
    reasons = F.array_compact(
        F.array(
            F.when(missing, "Missing Product Name"),
            F.when(~F.coalesce(price > 0, F.lit(False)), "Missing or invalid Product Price"),
            F.when(casts.lenient_quantity(F.col("quantity")) <= 0, "Missing or invalid Qty"),
            F.when(~F.col("platform").isin("Shopee", "Shopee SG", "Lazada", "ZENXIN"), "Missing or invalid Platform"),
        )
    )
    return rows.groupBy(F.array_join(reasons, "; ").alias("reasons"), (F.size(reasons) == 0).alias("normal")).agg(F.count("*").alias("n_rows"), F.sum("subtotal").alias("subtotal"))


@query
def review_exclusions(spark: SparkSession, d: str) -> DataFrame:
    """Orders with a row in review are left out whole: what stays, and what goes by its reasons in the order first seen."""
    rows = r.platform_products(spark, d)
    reason = F.when(casts.lenient_quantity(F.col("quantity")) <= 0, "QTY").when(F.col("price") == "free", "PRICE").when(F.col("product") == " N/A", "NAME")
    marked = rows.withColumn("reason", reason)
    gone = marked.where("reason IS NOT NULL").groupBy("order_id").agg(F.array_join(products.first_seen(F.col("reason"), F.col("item_index")), ", ").alias("reasons"))
    kept = rows.join(gone, "order_id", "left")
    return kept.groupBy("reasons").agg(F.count("*").alias("n_rows"), F.countDistinct("order_id").alias("n_orders"), F.sum("subtotal").alias("subtotal"))


@query
def name_keys(spark: SparkSession, d: str) -> DataFrame:
    """Listings' raw names, split, cleaned and made into comparison keys."""
    rows = r.listings(spark, d).withColumn("identity", text.product_identity(F.col("raw_name"), F.col("raw_variation")))
    variation = F.col("identity.variation")
    return rows.select(
        "sku",
        text.title(F.col("identity.name")).alias("title"),
        text.statement_name(F.col("identity.name")).alias("statement_key"),
        variation.alias("variation"),
        text.without_amount(variation, F.col("unit_price")).alias("clean_variation"),
        text.sku_text(F.col("seller_sku")).alias("seller_sku"),
        text.number_sku_text(F.col("unit_price")).alias("number_sku"),
        text.platform_label(F.concat(F.lit(" sHoPee"), F.when(F.col("sku").cast("long") % 2 == 0, " ").otherwise("x"))).alias("platform"),
        text.order_identity(F.lit("LAZADA"), F.when(F.col("sku").cast("long") % 7 == 0, " n/a").otherwise(F.col("sku")))["platform"].alias("identity_platform"),
        text.first_present(F.col("listing"), F.col("seller_sku")).alias("first_present"),
        text.or_placeholder(F.col("listing")).alias("shown"),
    )


@query
def written_values(spark: SparkSession, d: str) -> DataFrame:
    """Amounts, dates and numbers in the ways that sources write them, read strictly or leniently."""
    rows = c.orders(spark, d).select("order_id", F.col("order_id").cast("long").alias("key"), "final_amount", "created")
    shown = F.when(F.col("key") % 3 == 0, F.date_format("created", "yyyy-MM-dd")).when(F.col("key") % 3 == 1, F.date_format("created", "dd/MM/yyyy")).otherwise(F.date_format("created", "dd-MM-yyyy"))
    padded = F.concat(F.col("final_amount").cast("string"), F.when(F.col("key") % 2 == 0, "00").otherwise("5"))
    both = casts.price_and_total(F.lit(3), F.when(F.col("key") % 2 == 0, F.col("final_amount")), F.when(F.col("key") % 2 == 1, F.col("final_amount")))
    return rows.select(
        "order_id",
        casts.strict_date(F.when(F.col("key") % 5 == 0, " n/A ").otherwise(shown)).alias("day"),
        casts.money_text(padded).alias("money_text"),
        casts.fits(padded, 12, 2).alias("fits"),
        casts.checked_money(F.when(F.col("key") % 4 != 0, F.col("final_amount").cast("string"))).alias("checked"),
        both["price"].alias("price"),
        both["total"].alias("total"),
        casts.market_money(F.concat(F.lit("S$ "), F.col("final_amount").cast("string"), F.lit(" or $5 for A$"))).alias("market_text"),
        casts.currency_text(F.when(F.col("key") % 4 != 0, F.col("final_amount")), F.lit("RM")).alias("shown"),
        casts.lenient_quantity(F.format_number("final_amount", 2)).alias("quantity"),
        settlement.payment_status(F.when(F.col("key") % 3 == 0, F.col("created")), F.when(F.col("key") % 2 == 0, " Estimated")).alias("payment_status"),
    )


@query
def sku_components(spark: SparkSession, d: str) -> DataFrame:
    """The parts of the listings' SKUs, with what a sale of five scans."""
    rows = r.listings(spark, d).select("sku", F.posexplode(text.sku_components(F.col("listing"))).alias("place", "x"))
    return rows.select("sku", "place", "x.*", text.scan_quantity(F.lit(5), F.col("x.units")).alias("scanned"))


@query
def compact_barcodes(spark: SparkSession, d: str) -> DataFrame:
    """Sold products with barcode, bundle and price status; a bundle's quantity counts its units."""
    sold = products.product_summary(c.items(spark, d), ["sku"]).join(r.listings(spark, d).select("sku", "seller_sku", F.col("unit_price").alias("list_price")), "sku")
    discount = (F.col("list_price") * F.col("quantity") - F.col("amount")).cast(r.MONEY)
    bundle = text.bundle(F.col("seller_sku"), F.col("quantity"))
    override = text.price_override(F.col("bundle.status"), F.col("quantity"), F.col("discount"), F.col("amount"))
    rows = sold.select("sku", "seller_sku", "quantity", F.col("amount").cast(r.MONEY).alias("amount"), discount.alias("discount"), bundle.alias("bundle")).withColumn("override", override)
    return rows.select("sku", text.barcode(F.col("seller_sku")).alias("barcode"), F.col("bundle.status").alias("bundle_status"), F.col("bundle.multiplier").alias("multiplier"), F.col("bundle.pos_quantity").alias("pos_quantity"), F.col("override.status").alias("price_status"), F.col("override.price").alias("price"))


@query
def compact_barcode_totals(spark: SparkSession, d: str) -> DataFrame:
    """One row: how many products are of each status, and the units to scan."""
    rows = compact_barcodes(spark, d)
    of = lambda column, value: F.count_if(F.col(column) == value)
    return rows.agg(F.count("*").alias("n_products"), F.count("barcode").alias("n_barcodes"), of("bundle_status", "CONFIRMED_BUNDLE").alias("n_bundles"), of("bundle_status", "REVIEW_REQUIRED").alias("n_bundle_reviews"), of("price_status", "OVERRIDE_REQUIRED").alias("n_overrides"), of("price_status", "ROUNDING_REVIEW_REQUIRED").alias("n_price_reviews"), F.sum("pos_quantity").alias("pos_quantity"))


_REPORT = INVOICES + """
, e AS (SELECT order_id, count(*) FILTER (view_by NOT IN ('Order', 'Sku') OR (view_by = 'Order' AND released_c IS NULL)) AS broken, count(*) FILTER (view_by = 'Order' AND released_c IS NOT NULL) AS whole,
               count(DISTINCT CASE WHEN view_by = 'Order' AND released_c IS NOT NULL THEN concat_ws('|', payout, released_c, coalesce(refund_c::VARCHAR, '~')) END) AS facts, max(released_c) FILTER (view_by = 'Order') AS rel, max(refund_c) FILTER (view_by = 'Order') AS ref
        FROM income_c GROUP BY order_id),
s AS (SELECT i.*, CASE WHEN broken > 0 OR facts > 1 THEN 'Needs Review' WHEN coalesce(whole, 0) = 0 THEN 'No Settlement Evidence' ELSE 'Settled' END AS settlement, rel, ref FROM invoices_c i LEFT JOIN e USING (order_id)),
p AS (SELECT *, CASE WHEN settlement <> 'Settled' THEN 'Unavailable' WHEN ref IS NULL THEN 'Needs Review' WHEN coalesce(refund_c, 0) = 0 AND ref = 0 THEN 'No Refund' WHEN abs(coalesce(refund_c, 0) - ref) <= 2 THEN 'Matched' ELSE 'Mismatch' END AS refund_validation,
             CASE WHEN settlement = 'Settled' THEN CASE WHEN final_c IS NOT NULL THEN 'Final Amount' WHEN income_c IS NOT NULL THEN 'Order Income' END END AS source,
             CASE WHEN settlement = 'Settled' THEN rel - coalesce(final_c, income_c) END AS diff_c,
             CASE WHEN settlement = 'Settled' THEN CASE WHEN lower(trim(payment_status)) = 'pending' THEN 'Pending → Settled' WHEN lower(trim(payment_status)) = 'released' THEN 'Already Released → Settled' END END AS transition FROM s),
q AS (SELECT *, CASE WHEN settlement = 'Settled' THEN CASE WHEN source IS NULL THEN 'MISSING_COMPARISON_EVIDENCE' WHEN source = 'Order Income' AND income_type = 'Estimated' THEN 'ESTIMATED_ONLY' WHEN abs(diff_c) <= 2 THEN 'MATCHED' ELSE 'DIFFERENT' END END AS comparison FROM p)
"""
_PROOF = INVOICES + """
, ev AS (SELECT order_id, event_id, CASE WHEN order_id::BIGINT % 5 = 1 THEN 0 ELSE amount_c END AS a, event_id % 3 AS h FROM adjustments_c),
pr AS (SELECT i.order_id, sum(a) FILTER (h <> key % 3) AS cross_c, sum(a) FILTER (h = key % 3) AS cur_c, count(*) FILTER (h <> key % 3) AS n_cross, any_value(final_c - income_c) AS delta FROM invoices_c i JOIN ev USING (order_id) GROUP BY i.order_id),
proofs AS (SELECT *, CASE WHEN abs(cur_c - delta) <= 2 THEN 'CURRENT' WHEN n_cross > 0 AND cross_c = delta THEN 'CROSS_PERIOD' END AS proof FROM pr)
"""
_PLATFORM = """
, po AS (SELECT order_id, final_c, key, CASE key % 5 WHEN 0 THEN 'Shopee' WHEN 1 THEN 'Shopee SG' WHEN 2 THEN ' Lazada' WHEN 3 THEN 'ZENXIN' ELSE 'Other' END AS platform,
                CASE key % 5 WHEN 0 THEN CASE WHEN key % 9 > 1 THEN final_c ELSE 0 END WHEN 1 THEN CASE WHEN key % 9 > 1 THEN final_c ELSE 0 END WHEN 2 THEN CASE WHEN key % 8 <> 0 THEN final_c ELSE 0 END WHEN 3 THEN final_c END AS income_c FROM orders_c),
pp AS (SELECT i.*, CASE key % 5 WHEN 0 THEN 'Shopee' WHEN 1 THEN 'Shopee SG' WHEN 2 THEN ' Lazada' WHEN 3 THEN 'ZENXIN' ELSE 'Other' END AS platform, CASE WHEN key % 41 = 0 THEN 0 ELSE quantity END AS q FROM items_c i)
"""
_LISTINGS = """
, l0 AS (SELECT *, lpad(sku, 12, '0') AS t FROM master_c),
l AS (SELECT *, part AS key, t || ((10 - list_sum(list_transform(range(1, 13), lambda i: substr(t, i::INT, 1)::INT * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10) % 10)::INT AS code FROM l0),
li AS (SELECT *, CASE key % 8 WHEN 0 THEN 'nav: N' || sku || '-3' WHEN 1 THEN code || '-2' WHEN 2 THEN code || '-box' WHEN 3 THEN 'CODE' || sku WHEN 4 THEN code || '; NAV:X' || sku || ' ;' WHEN 5 THEN code || '-0' WHEN 6 THEN ' ' END AS listing,
              CASE key % 4 WHEN 0 THEN code WHEN 1 THEN code || '-' || key % 5 WHEN 2 THEN ' S' || sku ELSE '-' || sku END AS seller_sku FROM l)
"""
_BARCODES = _LISTINGS + """
, sold AS (SELECT sku, sum(quantity)::BIGINT AS q, sum(subtotal_c) AS a FROM items_c GROUP BY sku),
b0 AS (SELECT sku, q, a, price_c * q - a AS d, CASE WHEN key % 4 < 2 THEN code END AS barcode, CASE key % 4 WHEN 1 THEN key % 5 WHEN 3 THEN key END AS suffix, key % 4 = 3 AS bare FROM sold JOIN li USING (sku)),
b1 AS (SELECT *, CASE WHEN suffix IS NULL THEN 'NORMAL' WHEN bare OR suffix = 0 OR q <= 0 THEN 'REVIEW_REQUIRED' ELSE 'CONFIRMED_BUNDLE' END AS bundle_status,
              a // q + CASE WHEN 2 * (a % q) > q OR (2 * (a % q) = q AND (a // q) % 2 = 1) THEN 1 ELSE 0 END AS p FROM b0),
bc AS (SELECT sku, barcode, bundle_status, CASE WHEN bundle_status = 'CONFIRMED_BUNDLE' THEN suffix END AS multiplier, CASE bundle_status WHEN 'CONFIRMED_BUNDLE' THEN q * suffix WHEN 'NORMAL' THEN q END AS pos_quantity,
              CASE WHEN bundle_status <> 'NORMAL' THEN 'BUNDLE_PRICE_REVIEW_REQUIRED' WHEN d >= 0 THEN 'NOT_REQUIRED' WHEN p * q <> a THEN 'ROUNDING_REVIEW_REQUIRED' ELSE 'OVERRIDE_REQUIRED' END AS price_status, p FROM b1)
"""

BODIES = {
    "settlement_reporting": _REPORT + """
SELECT settlement, refund_validation, CASE WHEN settlement = 'No Settlement Evidence' THEN settlement WHEN settlement = 'Settled' AND refund_validation IN ('Matched', 'No Refund') THEN 'Ready to Invoice' ELSE 'Needs Review' END AS ready,
       source, comparison, transition, CASE WHEN settlement = 'Settled' THEN 'Settled' ELSE payment_status END AS effective_payment, count(*) AS n_orders, sum(diff_c) / 100.0 AS difference FROM q GROUP BY ALL""",
    "settlement_summary": _REPORT + """
, ids AS (SELECT DISTINCT order_id FROM income_c WHERE view_by = 'Order' AND payout IS NOT NULL AND released_c IS NOT NULL)
SELECT count(*) AS n_orders, count(*) FILTER (settlement = 'No Settlement Evidence') AS n_no_evidence, count(*) FILTER (transition LIKE 'Pending%') AS n_pending_to_released, count(*) FILTER (transition LIKE 'Already%') AS n_already_released,
       count(*) FILTER (comparison = 'DIFFERENT') AS n_different, count(*) FILTER (comparison = 'MATCHED') AS n_matched, count(*) FILTER (comparison = 'ESTIMATED_ONLY') AS n_estimated_only, count(*) FILTER (comparison = 'MISSING_COMPARISON_EVIDENCE') AS n_missing_comparison_evidence,
       (SELECT count(*) FROM ids) AS n_statement_orders, (SELECT count(*) FROM ids WHERE order_id IN (SELECT order_id FROM orders_c)) AS n_covered, (SELECT count(*) FROM ids WHERE order_id NOT IN (SELECT order_id FROM orders_c)) AS n_unmatched FROM q""",
    "adjustment_proofs": _PROOF + "SELECT proof, count(*) AS n_orders, sum(cross_c) / 100.0 AS cross_total, sum(cur_c) / 100.0 AS current_total FROM proofs GROUP BY proof",
    "order_waterfalls": _PROOF + """
, w AS (SELECT i.order_id, i.key, proof, lower(trim(income_type)) AS state, CASE WHEN i.key % 10 = 1 THEN income_c - 50 ELSE income_c END AS inc, CASE WHEN i.key % 10 <> 1 THEN final_c END AS fin, product AS sm, CASE WHEN i.key % 17 <> 0 THEN coalesce(refund, 0) END AS sr, discount AS sv, fee AS sf,
               CASE WHEN i.key % 10 = 1 THEN product - 50 ELSE product END AS im, CASE WHEN i.key % 16 <> 5 THEN refund_c END AS ir, CASE WHEN i.key % 19 <> 0 THEN fee END AS if_
        FROM invoices_c i JOIN statements_c USING (order_id) JOIN sums s USING (order_id) LEFT JOIN proofs USING (order_id)),
u AS (SELECT *, coalesce(state IN ('final', 'estimated'), false) AND inc IS NOT NULL AND sr IS NOT NULL AND (fin IS NULL OR fin = inc OR proof IS NOT NULL) AS ok FROM w),
v AS (SELECT *, coalesce(ok AND state = 'estimated' AND key % 3 <> 0 AND ir IS NULL AND sr <> 0, false) AS late FROM u),
x AS (SELECT *, sm + sr + sv + sf AS total, sm + sr + sv + sf - inc AS raw, sm - im + coalesce(sr - ir, CASE WHEN late THEN sr ELSE 0 END) + coalesce(sf - if_, 0) AS expl, (ir IS NULL AND sr <> 0 AND NOT late) OR (if_ IS NULL AND sf <> 0) AS missing FROM v)
SELECT CASE WHEN NOT ok THEN 'NONE' WHEN abs(raw) <= 2 THEN 'EXACT' WHEN NOT missing AND abs(raw - expl) <= 2 THEN 'EXPLAINED' ELSE 'NONE' END AS basis, late AS late_refund, proof, count(*) AS n_orders,
       sum(total) FILTER (ok) / 100.0 AS statement_total, sum(raw) FILTER (ok) / 100.0 AS raw_difference, sum(expl) FILTER (ok) / 100.0 AS explained_delta, sum(raw - expl) FILTER (ok) / 100.0 AS residual FROM x GROUP BY ALL""",
    "overall_dashboard": _PLATFORM + "SELECT (SELECT count(*) FROM po) AS n_orders, (SELECT sum(income_c) / 100.0 FROM po) AS income, count(*) AS n_products, sum(q)::BIGINT AS quantity, (SELECT count(DISTINCT payout) FROM statements_c) AS n_sources FROM pp",
    "platform_dashboards": _PLATFORM + """
, o AS (SELECT platform, count(*) AS n_orders, coalesce(sum(income_c), 0) / 100.0 AS income, sum(final_c) / 100.0 AS gross_sales, (sum(CASE WHEN key % 7 <> 0 THEN 1250 ELSE 0 END) - sum(CASE WHEN key % 3 = 0 THEN 500 ELSE 0 END)) / 100.0 AS fees, sum(final_c) / 100.0 AS net_amount FROM po GROUP BY platform)
SELECT o.*, coalesce(n_products, 0) AS n_products, coalesce(quantity, 0)::BIGINT AS quantity FROM o LEFT JOIN (SELECT platform, count(*) AS n_products, sum(q) AS quantity FROM pp GROUP BY platform) USING (platform)""",
    "validation_dashboard": _PLATFORM + "SELECT count(*) AS n_orders, sum(final_c) FILTER (key % 9 > 1) / 100.0 AS order_income, sum(final_c) FILTER (key % 7 <> 0) / 100.0 AS final_amount, count(*) FILTER (key % 7 <> 0) AS n_final, (SELECT count(*) FROM pp) AS n_products, (SELECT sum(q)::BIGINT FROM pp) AS quantity FROM po",
    "reconciliation_status": """
, t AS (SELECT s.state, s.status, count(rec.state) AS n FROM (VALUES ('RECONCILED', 'Reconciled'), ('MISSING_STATEMENT', 'Pending statement'), ('MISMATCH', 'Mismatch')) s(state, status) LEFT JOIN rec USING (state) GROUP BY ALL)
SELECT status, n AS n_orders, n / sum(n) OVER () AS share FROM t""",
    "upload_outcomes": """
SELECT kind AS action, count(*) AS n_processed, count(*) FILTER (event_id % 6 IN (0, 4)) AS n_imported, count(*) FILTER (event_id % 6 = 1) AS n_review, count(*) FILTER (event_id % 6 = 2) AS n_duplicate, count(*) FILTER (event_id % 6 = 3) AS n_unsupported, count(*) FILTER (event_id % 6 = 5) AS n_error
FROM adjustments_c GROUP BY kind""",
    "review_reasons": _PLATFORM + """
, m AS (SELECT concat_ws('; ', CASE WHEN key % 31 = 0 OR product IS NULL THEN 'Missing Product Name' END, CASE WHEN key % 37 = 0 OR price_c IS NULL THEN 'Missing or invalid Product Price' END, CASE WHEN key % 41 = 0 OR quantity <= 0 THEN 'Missing or invalid Qty' END,
                         CASE WHEN platform IN (' Lazada', 'Other') THEN 'Missing or invalid Platform' END) AS reasons, subtotal_c FROM pp LEFT JOIN master_c USING (sku))
SELECT reasons, reasons = '' AS normal, count(*) AS n_rows, sum(subtotal_c) / 100.0 AS subtotal FROM m GROUP BY ALL""",
    "review_exclusions": """
, m AS (SELECT *, CASE WHEN key % 41 = 0 THEN 'QTY' WHEN key % 37 = 0 THEN 'PRICE' WHEN key % 31 = 0 THEN 'NAME' END AS reasons FROM items_c)
SELECT reasons, count(*) AS n_rows, count(DISTINCT order_id) AS n_orders, sum(subtotal_c) / 100.0 AS subtotal FROM m GROUP BY reasons""",
    "name_keys": _LISTINGS + r"""
, n AS (SELECT *, trim(regexp_replace(CASE WHEN key % 5 = 0 THEN 'Pre-Order F ree ' ELSE '' END || product || CASE WHEN key % 3 = 1 THEN ' & Co' ELSE '' END, '\s+', ' ', 'g')) AS name,
              variation || CASE WHEN key % 3 = 0 THEN '' WHEN key % 4 = 0 THEN ' RM ' || format('{:,}.{:02d}', price_c // 100, price_c % 100) WHEN key % 4 = 1 THEN ' 1.00' ELSE '' END AS v FROM li)
SELECT sku, CASE WHEN key % 5 = 0 THEN 'Free ' || substr(name, 17) ELSE name END AS title, replace(lower(name), ' & ', ' and ') AS statement_key, v AS variation, CASE WHEN key % 3 <> 0 AND key % 4 = 0 THEN variation WHEN key % 3 <> 0 AND key % 4 = 1 AND price_c = 100 THEN variation ELSE v END AS clean_variation,
       trim(seller_sku) AS seller_sku, rtrim(rtrim((price_c / 100.0)::DECIMAL(18,2)::VARCHAR, '0'), '.') AS number_sku, CASE WHEN key % 2 = 0 THEN 'Shopee' ELSE 'sHoPeex' END AS platform, CASE WHEN key % 7 <> 0 THEN 'Lazada' END AS identity_platform,
       coalesce(nullif(trim(listing), ''), trim(seller_sku)) AS first_present, coalesce(nullif(trim(listing), ''), 'N/A') AS shown FROM n""",
    "written_values": r"""
, w AS (SELECT *, final_c // 100 AS whole, final_c % 100 AS rest, (final_c / 100.0)::DECIMAL(18,2)::VARCHAR AS t FROM orders_c)
SELECT order_id, CASE WHEN key % 5 <> 0 THEN created END AS day, CASE WHEN key % 2 = 1 THEN t || '5' ELSE rtrim(rtrim(t, '0'), '.') END AS money_text, key % 2 = 0 AS fits, CASE WHEN key % 4 <> 0 THEN final_c / 100.0 END AS checked,
       CASE WHEN key % 2 = 0 THEN final_c ELSE final_c // 3 + CASE WHEN final_c % 3 = 2 THEN 1 ELSE 0 END END / 100.0 AS price, CASE WHEN key % 2 = 0 THEN final_c * 3 ELSE final_c END / 100.0 AS total, 'RM' || t || ' or RM5 for A$' AS market_text,
       CASE WHEN key % 4 <> 0 THEN 'RM ' || format('{:,}.{:02d}', whole, rest) ELSE 'N/A' END AS shown, whole::INT AS quantity, CASE WHEN key % 3 = 0 THEN 'Released' WHEN key % 2 = 0 THEN 'Pending' ELSE 'N/A' END AS payment_status FROM w""",
    "sku_components": _LISTINGS + """
, x AS (
  SELECT sku, 0 AS place, listing AS original, 'N' || sku AS identifier, 'NAV' AS kind, 3 AS units, 'MANUAL_ENTRY_REQUIRED' AS status FROM li WHERE key % 8 = 0
  UNION ALL SELECT sku, 0, listing, code, 'EAN13', CASE WHEN key % 8 = 1 THEN 2 ELSE 1 END, 'READY' FROM li WHERE key % 8 IN (1, 2)
  UNION ALL SELECT sku, 0, listing, listing, 'MANUAL_CODE', 1, 'MANUAL_ENTRY_REQUIRED' FROM li WHERE key % 8 = 3
  UNION ALL SELECT sku, 0, code, code, 'EAN13', 1, 'READY' FROM li WHERE key % 8 = 4
  UNION ALL SELECT sku, 1, 'NAV:X' || sku, 'X' || sku, 'NAV', 1, 'MANUAL_ENTRY_REQUIRED' FROM li WHERE key % 8 = 4
  UNION ALL SELECT sku, 2, '', '', 'MANUAL_CODE', NULL, 'REVIEW_REQUIRED' FROM li WHERE key % 8 = 4
  UNION ALL SELECT sku, 0, listing, listing, 'MANUAL_CODE', NULL, 'REVIEW_REQUIRED' FROM li WHERE key % 8 = 5)
SELECT sku, place, original, identifier, kind, units, status, units * 5 AS scanned FROM x""",
    "compact_barcodes": _BARCODES + "SELECT sku, barcode, bundle_status, multiplier::BIGINT AS multiplier, pos_quantity::BIGINT AS pos_quantity, price_status, CASE WHEN price_status = 'OVERRIDE_REQUIRED' THEN p / 100.0 END AS price FROM bc",
    "compact_barcode_totals": _BARCODES + """
SELECT count(*) AS n_products, count(barcode) AS n_barcodes, count(*) FILTER (bundle_status = 'CONFIRMED_BUNDLE') AS n_bundles, count(*) FILTER (bundle_status = 'REVIEW_REQUIRED') AS n_bundle_reviews,
       count(*) FILTER (price_status = 'OVERRIDE_REQUIRED') AS n_overrides, count(*) FILTER (price_status = 'ROUNDING_REVIEW_REQUIRED') AS n_price_reviews, sum(pos_quantity)::BIGINT AS pos_quantity FROM bc""",
}

SQL = {name: CANONICAL + body for name, body in BODIES.items()}
