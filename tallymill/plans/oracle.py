"""DuckDB SQL of the registered queries' rows, over the same canonical relations."""

from __future__ import annotations

CANONICAL = """
WITH orders_c AS (
  SELECT CASE WHEN c_nationkey % 2 = 0 THEN 'MY' ELSE 'SG' END AS market, o_orderkey::VARCHAR AS order_id, o_orderkey AS key,
         CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'To Ship' ELSE 'Cancelled' END AS status,
         o_orderdate::DATE AS created, floor(o_totalprice * 100 + 0.5)::BIGINT AS final_c
  FROM orders JOIN customer ON o_custkey = c_custkey),
lines AS (
  SELECT l_orderkey AS key, l_orderkey::VARCHAR AS order_id, l_partkey AS part, l_partkey::VARCHAR AS sku, l_quantity::INT AS quantity, l_returnflag AS flag, l_shipdate::DATE AS shipped,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)::INT - 1 AS item_index,
         floor(l_extendedprice * 100 + 0.5)::BIGINT AS original_c,
         floor(l_extendedprice * 100 + 0.5)::BIGINT * (100 - floor(l_discount * 100 + 0.5)::BIGINT) AS x, floor(l_tax * 100 + 0.5)::BIGINT AS tax
  FROM lineitem),
priced AS (SELECT *, x // 100 + (CASE WHEN x % 100 > 50 OR (x % 100 = 50 AND (x // 100) % 2 = 1) THEN 1 ELSE 0 END) AS subtotal_c FROM lines),
items_c AS (
  SELECT *, (subtotal_c * tax) // 100 + (CASE WHEN (subtotal_c * tax) % 100 > 50 OR ((subtotal_c * tax) % 100 = 50 AND ((subtotal_c * tax) // 100) % 2 = 1) THEN 1 ELSE 0 END) AS fee_c
  FROM priced),
sums AS (
  SELECT order_id, key, sum(original_c) AS product, -sum(original_c - subtotal_c) AS discount, -sum(fee_c) AS fee,
         -sum(CASE WHEN flag = 'R' AND quantity >= 40 THEN subtotal_c END) AS refund, max(shipped) AS payout
  FROM items_c GROUP BY ALL),
components_c AS (
  SELECT order_id, 'Product Price' AS name, product AS amount_c FROM sums UNION ALL SELECT order_id, 'Discount', discount FROM sums
  UNION ALL SELECT order_id, 'Transaction Fee', fee FROM sums UNION ALL SELECT order_id, 'Refund Amount', refund FROM sums WHERE refund IS NOT NULL),
statements_c AS (
  SELECT order_id, payout, product + discount + fee + coalesce(refund, 0) + CASE key % 7 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 0 END AS released_c FROM sums WHERE key % 7 <> 2),
facts AS (
  SELECT order_id, count(*) AS n_components, coalesce(sum(amount_c) FILTER (name NOT IN ('Product Price', 'Refund Amount') AND amount_c < 0), 0) AS charges_c,
         coalesce(sum(amount_c) FILTER (name NOT IN ('Product Price', 'Refund Amount') AND amount_c > 0), 0) AS credits_c,
         coalesce(sum(amount_c) FILTER (name = 'Refund Amount'), 0) AS refund_c, coalesce(sum(amount_c) FILTER (name = 'Product Price'), 0) AS sales_c,
         coalesce(sum(amount_c) FILTER (name <> 'Product Price'), 0) AS non_product_c
  FROM components_c GROUP BY order_id),
adjustments_c AS (
  SELECT event_id, user_id::VARCHAR AS order_id, event_type AS kind, ts::DATE AS day, floor(value * 100 + 0.5)::BIGINT AS amount_c FROM events),
adjusted AS (SELECT order_id, sum(amount_c) AS adjusted_c, count(*) AS n_adjustments FROM adjustments_c GROUP BY order_id),
rec AS (
  SELECT o.*, f.* EXCLUDE (order_id), s.released_c, s.payout, coalesce(adjusted_c, 0) AS adjusted_c, coalesce(n_adjustments, 0) AS n_adjustments,
         sales_c + non_product_c AS expected_c, released_c - sales_c - non_product_c AS difference_c,
         CASE WHEN n_components IS NULL THEN 'INSUFFICIENT_DATA' WHEN released_c IS NULL THEN 'MISSING_STATEMENT'
              WHEN abs(released_c - sales_c - non_product_c) <= 2 THEN 'RECONCILED' ELSE 'MISMATCH' END AS state
  FROM orders_c o LEFT JOIN facts f USING (order_id) LEFT JOIN statements_c s USING (order_id) LEFT JOIN adjusted USING (order_id)),
master_c AS (
  SELECT p_partkey AS part, p_partkey::VARCHAR AS sku, p_brand AS parent, p_name AS product, p_type AS variation, floor(p_retailprice * 100 + 0.5)::BIGINT AS price_c FROM part)
"""

INVOICES = """
, invoices_c AS (
  SELECT o.order_id, o.key, o.market, o.created, o.status,
         CASE key % 4 WHEN 0 THEN 'Final' WHEN 1 THEN 'Estimated' WHEN 2 THEN ' final' END AS income_type,
         CASE WHEN key % 5 <> 0 THEN s.product + s.discount + s.fee + coalesce(s.refund, 0) + CASE WHEN key % 13 = 0 THEN 5 ELSE 0 END END AS final_c,
         CASE WHEN key % 15 <> 0 THEN s.product + s.discount + s.fee + coalesce(s.refund, 0) END AS income_c,
         CASE key % 6 WHEN 0 THEN 'Pending' WHEN 1 THEN 'RELEASED' WHEN 2 THEN ' released ' WHEN 3 THEN 'pending' WHEN 5 THEN 'N/A' END AS payment_status,
         CASE WHEN key % 9 < 3 THEN o.created + 10 END AS transferred_on, st.payout AS released_on,
         CASE WHEN key % 8 = 1 THEN s.refund - 100 ELSE s.refund END AS refund_c
  FROM orders_c o LEFT JOIN sums s USING (order_id, key) LEFT JOIN statements_c st USING (order_id)),
income_c AS (
  SELECT order_id, 'Order' AS view_by, payout, CASE WHEN key % 14 <> 3 THEN released_c END AS released_c, refund AS refund_c FROM statements_c JOIN sums USING (order_id, payout)
  UNION ALL SELECT order_id, 'Order', payout, released_c + (key % 12)::INT, refund FROM statements_c JOIN sums USING (order_id, payout) WHERE key % 12 < 2
  UNION ALL SELECT order_id, 'Other', payout, released_c, refund FROM statements_c JOIN sums USING (order_id, payout) WHERE key % 50 = 7
  UNION ALL SELECT order_id, 'Sku', shipped, subtotal_c, NULL FROM items_c)
"""

_TREND = """
SELECT market, {day} AS day, count(*) AS n_orders, sum(sales_c) / 100.0 AS sales, sum(charges_c) / 100.0 AS charges
FROM rec WHERE created >= DATE '1995-03-10' GROUP BY ALL"""

_SNAPSHOT = """, old AS (SELECT * FROM orders_c WHERE created < DATE '1997-01-01'),
new AS (SELECT * REPLACE (CASE WHEN key % 11 = 0 THEN 'Returned' ELSE status END AS status) FROM orders_c WHERE created >= DATE '1994-01-01')
"""

BODIES = {
    "order_settlement_report": "SELECT market, date_trunc('month', created)::DATE AS month, state, count(*) AS n_orders, sum(expected_c) / 100.0 AS expected, sum(released_c) / 100.0 AS released, sum(difference_c) / 100.0 AS difference FROM rec GROUP BY ALL",
    "order_reconciliation": "SELECT order_id, market, status, expected_c / 100.0 AS expected, released_c / 100.0 AS released, difference_c / 100.0 AS difference, adjusted_c / 100.0 AS adjusted, n_adjustments, state FROM rec",
    "order_facts": "SELECT order_id, n_components, charges_c / 100.0 AS charges, credits_c / 100.0 AS credits, refund_c / 100.0 AS refund, sales_c / 100.0 AS sales, non_product_c / 100.0 AS non_product FROM facts",
    "component_ledger": "SELECT order_id, name, amount_c / 100.0 AS amount FROM components_c",
    "component_totals": "SELECT market, name, sign(amount_c)::INT AS sign, sum(amount_c) / 100.0 AS amount, count(*) AS n_rows FROM components_c JOIN orders_c USING (order_id) GROUP BY ALL",
    "report_metrics": """
SELECT count(*) AS n_orders, count(released_c) AS n_settled, CASE WHEN count(*) = count(expected_c) THEN sum(expected_c) / 100.0 END AS expected,
       sum(expected_c) / 100.0 AS expected_known, sum(released_c) / 100.0 AS released, abs(sum(refund_c)) / 100.0 AS refunds,
       sum(difference_c) FILTER (released_c IS NOT NULL) / 100.0 AS difference, count(released_c) / count(*) AS coverage FROM rec""",
    "state_counts": """
SELECT s.state, count(rec.state) AS n_orders, count(rec.state) * 100.0 / sum(count(rec.state)) OVER () AS share
FROM (VALUES ('RECONCILED'), ('MISMATCH'), ('INSUFFICIENT_DATA'), ('MISSING_STATEMENT')) s(state) LEFT JOIN rec USING (state) GROUP BY s.state""",
    "settlement_waterfall": """
, t AS (SELECT sum(sales_c) AS sales, sum(charges_c) AS charges, sum(credits_c) AS credits, sum(refund_c) AS refund, sum(expected_c) AS expected FROM rec)
SELECT step, amount / 100.0 AS amount FROM (
  SELECT 'sales' AS step, sales AS amount FROM t UNION ALL SELECT 'charges', charges FROM t UNION ALL SELECT 'credits', credits FROM t UNION ALL SELECT 'refund', refund FROM t
  UNION ALL SELECT 'other', expected - sales - charges - credits - refund FROM t UNION ALL SELECT 'expected', expected FROM t)""",
    "trend_daily": _TREND.format(day="created"),
    "trend_weekly": _TREND.format(day="DATE '1995-03-10' + ((created - DATE '1995-03-10') // 7 * 7)::INT"),
    "trend_monthly": _TREND.format(day="greatest(date_trunc('month', created)::DATE, DATE '1995-03-10')"),
    "analysis_filters": """
SELECT order_id, market, created, refund_c / 100.0 AS refund, state FROM rec
WHERE status IN ('Completed', 'To Ship') AND created BETWEEN DATE '1994-01-01' AND DATE '1997-06-30' AND state IN ('RECONCILED', 'MISMATCH') AND refund_c <> 0
  AND order_id IN (SELECT order_id FROM components_c WHERE name = 'Transaction Fee')""",
    "eligible_orders": "SELECT market, status, count(*) AS n_orders, sum(final_c) / 100.0 AS final_amount FROM orders_c WHERE status = 'Completed' AND order_id IN (SELECT order_id FROM items_c) GROUP BY ALL",
    "product_summary": """
SELECT sku, sum(quantity)::BIGINT AS quantity, sum(original_c) / 100.0 AS original, sum(subtotal_c) / 100.0 AS amount, count(*) AS n_items, count(DISTINCT order_id) AS n_orders,
       CASE WHEN count(DISTINCT unit_c) = 1 THEN max(unit_c) / 100.0 END AS unit_price, sum(original_c - subtotal_c) / 100.0 AS discount
FROM (SELECT *, original_c // quantity + CASE WHEN 2 * (original_c % quantity) > quantity OR (2 * (original_c % quantity) = quantity AND (original_c // quantity) % 2 = 1) THEN 1 ELSE 0 END AS unit_c FROM items_c)
GROUP BY sku""",
    "top_products": """
SELECT sku, sum(quantity)::BIGINT AS quantity, sum(subtotal_c) / 100.0 AS amount, round((sum(subtotal_c) / 100.0) * 100 / (sum(sum(subtotal_c)) OVER () / 100.0), 6) AS share
FROM items_c GROUP BY sku ORDER BY amount DESC, sku LIMIT 10""",
    "master_lookup": """
, i AS (SELECT CASE WHEN part % 3 = 0 THEN 'X-' || sku ELSE sku END AS sku, product, variation, parent, subtotal_c FROM items_c JOIN master_c USING (sku, part)),
a AS (SELECT sku, count(*) AS n, min(price_c) AS p FROM master_c GROUP BY ALL), b AS (SELECT product, variation, count(*) AS n, min(price_c) AS p FROM master_c GROUP BY ALL),
r AS (SELECT i.subtotal_c, CASE WHEN a.n IS NOT NULL THEN 'SKU' ELSE 'NAME_VARIATION' END AS tier, coalesce(a.n, b.n) AS n, coalesce(a.p, b.p) AS p FROM i LEFT JOIN a USING (sku) LEFT JOIN b USING (product, variation))
SELECT tier, CASE WHEN n = 1 THEN 'MATCHED' ELSE 'CONFLICT' END AS outcome, count(*) AS n_items, sum(CASE WHEN n = 1 THEN p END) / 100.0 AS master_price, sum(subtotal_c) / 100.0 AS subtotal FROM r GROUP BY ALL""",
    "promotion_allocation": """
, t AS (SELECT *, sum(subtotal_c) OVER g AS w, (sum(subtotal_c) OVER g) * 97 // 100 AS total FROM items_c WINDOW g AS (PARTITION BY order_id, flag)),
f AS (SELECT *, total::HUGEINT * subtotal_c // w AS fl, total::HUGEINT * subtotal_c % w AS rest FROM t),
k AS (SELECT *, total - sum(fl) OVER (PARTITION BY order_id, flag) AS spare, row_number() OVER (PARTITION BY order_id, flag ORDER BY rest DESC, sku, item_index) AS r FROM f)
SELECT order_id, flag, item_index, sku, total::BIGINT AS total, (fl + CASE WHEN r <= spare THEN 1 ELSE 0 END)::BIGINT AS allocated FROM k""",
    "promotion_pricing": """
, t AS (SELECT *, sum(original_c - subtotal_c) OVER g AS total, sum(quantity) OVER g AS w, count(*) OVER g AS n, row_number() OVER (g ORDER BY item_index) AS r FROM items_c WINDOW g AS (PARTITION BY order_id)),
s AS (SELECT *, total * quantity // w + CASE WHEN 2 * (total * quantity % w) > w OR (2 * (total * quantity % w) = w AND (total * quantity // w) % 2 = 1) THEN 1 ELSE 0 END AS share FROM t)
SELECT order_id, item_index, total::BIGINT AS total,
       (CASE WHEN r = n THEN total - coalesce(sum(share) OVER (PARTITION BY order_id ORDER BY item_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE share END)::BIGINT AS allocated FROM s""",
    "unit_allocation": """
, t AS (SELECT *, sum(fee_c) OVER g AS total, sum(quantity) OVER g AS w, coalesce(sum(quantity) OVER (g ORDER BY item_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM items_c WINDOW g AS (PARTITION BY order_id))
SELECT order_id, item_index, total::BIGINT AS total, (total // w * quantity + greatest(0, least(quantity, total % w - before)))::BIGINT AS allocated FROM t""",
    "snapshot_classes": _SNAPSHOT + """
SELECT market, order_id, CASE WHEN old.key IS NULL THEN 'NEW' WHEN new.key IS NULL THEN 'RETAINED' WHEN old.status = new.status THEN 'UNCHANGED' ELSE 'UPDATED' END AS change
FROM old FULL JOIN new USING (market, order_id)""",
    "snapshot_merge": _SNAPSHOT + """
SELECT market, order_id, coalesce(new.status, old.status) AS status, coalesce(new.created, old.created) AS created, coalesce(new.final_c, old.final_c) / 100.0 AS final_amount FROM old FULL JOIN new USING (market, order_id)""",
    "snapshot_missing_only": _SNAPSHOT + "SELECT market, order_id, status FROM new WHERE order_id NOT IN (SELECT order_id FROM old)",
    "fact_evidence": """
SELECT order_id || '/' || kind AS fact, count(*) AS n_rows, CASE WHEN count(*) = 1 THEN 'AVAILABLE' WHEN count(DISTINCT (day, amount_c)) = 1 THEN 'DUPLICATE' ELSE 'CONFLICTING' END AS evidence,
       CASE WHEN count(DISTINCT (day, amount_c)) = 1 THEN max(day) END AS day, CASE WHEN count(DISTINCT (day, amount_c)) = 1 THEN max(amount_c) / 100.0 END AS amount FROM adjustments_c GROUP BY order_id, kind""",
    "duplicate_rows": "SELECT l_orderkey::VARCHAR AS order_id, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "orphan_adjustments": "SELECT kind, count(*) AS n_events, sum(amount_c) / 100.0 AS amount FROM adjustments_c WHERE order_id NOT IN (SELECT order_id FROM orders_c) GROUP BY kind",
    "orders_without_items": "SELECT order_id, market, status FROM orders_c WHERE order_id NOT IN (SELECT order_id FROM items_c)",
    "first_adjustments": "SELECT order_id, kind, event_id, day, amount_c / 100.0 AS amount FROM adjustments_c QUALIFY row_number() OVER (PARTITION BY order_id, kind ORDER BY day, event_id) = 1",
    "event_percentiles": """
SELECT kind, count(*) AS n_events, quantile_disc(amount_c, 0.5) / 100.0 AS median, quantile_disc(amount_c, 0.95) / 100.0 AS p95, sum(amount_c) / 100.0 AS amount FROM adjustments_c GROUP BY kind""",
    "billing_periods": """
SELECT date_trunc('week', payout)::DATE AS period, count(*) AS n_orders, count(DISTINCT market) AS n_markets, sum(released_c) / 100.0 AS released, min(payout) AS first_day, max(payout) AS last_day
FROM statements_c JOIN orders_c USING (order_id) GROUP BY ALL""",
    "billing_controls": """
, scope AS (SELECT order_id, market FROM orders_c WHERE status <> 'Cancelled' AND order_id IN (SELECT order_id FROM statements_c)),
i AS (SELECT market, count(DISTINCT order_id) AS n_orders, count(DISTINCT sku) AS n_products, sum(quantity)::BIGINT AS quantity, sum(original_c) AS o, sum(subtotal_c) AS a FROM items_c JOIN scope USING (order_id) GROUP BY market),
n AS (SELECT market, sum(amount_c) AS native FROM components_c JOIN scope USING (order_id) WHERE name IN ('Product Price', 'Discount') GROUP BY market)
SELECT market, n_orders, n_products, quantity, o / 100.0 AS original, a / 100.0 AS amount, native / 100.0 AS native_amount, (o - a) / 100.0 AS discount, a = native AS balanced FROM i JOIN n USING (market)""",
    "fee_breakdown": """
SELECT state, name, sum(amount_c) / 100.0 AS amount, count(*) AS n_rows FROM components_c JOIN rec USING (order_id)
WHERE released_c IS NOT NULL AND name NOT IN ('Product Price', 'Refund Amount') GROUP BY ALL""",
    "pricing_anomalies": """
SELECT parent, count(*) FILTER (quantity * price_c - subtotal_c < -2) AS n_anomalies, count(*) AS n_items, sum(quantity * price_c - subtotal_c) / 100.0 AS discount FROM items_c JOIN master_c USING (sku) GROUP BY parent""",
    "row_eligibility": """
, r AS (SELECT concat_ws(';', CASE WHEN product IS NULL THEN 'NO_MASTER' END, CASE WHEN quantity > 48 THEN 'QUANTITY' END, CASE WHEN flag = 'R' THEN 'RETURNED' END, CASE WHEN subtotal_c < 100000 THEN 'SMALL_AMOUNT' END) AS reasons, subtotal_c
        FROM items_c LEFT JOIN master_c USING (sku))
SELECT reasons, reasons = '' AS normal, count(*) AS n_items, sum(subtotal_c) / 100.0 AS amount FROM r GROUP BY ALL""",
    "exception_queue": """
, i AS (SELECT order_id, 0 AS position, state AS reason, state = 'MISMATCH' AS blocking, 'review' AS action FROM rec WHERE state <> 'RECONCILED'
        UNION ALL SELECT order_id, 1, 'LARGE_ADJUSTMENT', FALSE, 'confirm' FROM rec WHERE n_adjustments > 0 AND abs(adjusted_c) > 10000)
SELECT order_id, min_by(reason, position) || CASE WHEN count(*) > 1 THEN ' +' || (count(*) - 1) || ' more' ELSE '' END AS reason, count(*) AS n_issues, bool_or(blocking) AS blocking, string_agg(DISTINCT action, ', ' ORDER BY action) AS actions
FROM i GROUP BY order_id""",
    "text_casts": "SELECT order_id, final_c / 100.0 AS lenient, (final_c // 100)::INT AS quantity, final_c / 100.0 AS strict, NULL::DOUBLE AS not_strict, -final_c / 100.0 AS statement FROM orders_c",
    "barcodes": r"""
, b AS (SELECT *, lpad(sku, 13, '0') AS code, trim(regexp_replace(product || ' ' || variation || ' ' || product, '\s+', ' ', 'g')) AS l FROM master_c)
SELECT sku, code, (10 - list_sum(list_transform(range(1, 13), lambda i: substr(code, i::INT, 1)::INT * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10) % 10 = substr(code, 13, 1)::INT AS is_ean13,
       nullif(length(product) % 10, 0)::BIGINT AS suffix, regexp_replace(regexp_replace(upper(variation), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS kind, CASE WHEN length(l) > 24 THEN rtrim(l[1:23]) || '…' ELSE l END AS label FROM b""",
    "period_labels": """
, m AS (SELECT date_trunc('month', payout)::DATE AS month, min(payout) AS first_day, max(payout) AS last_day, count(*) AS n_orders FROM statements_c GROUP BY ALL)
SELECT *, strftime(month, '%B %Y') AS label, CASE WHEN last_day - month > 365 THEN 'monthly' WHEN last_day - month > 90 THEN 'weekly' ELSE 'daily' END AS granularity FROM m""",
    "transaction_closure": INVOICES + """
, t AS (SELECT *, CASE WHEN released_on IS NOT NULL AND lower(trim(payment_status)) = 'released' THEN 'STATEMENT_ORIGINAL_PAYOUT'
                       WHEN transferred_on IS NOT NULL AND lower(trim(coalesce(payment_status, ''))) <> 'pending' THEN 'INVOICE_FUND_TRANSFER'
                       WHEN lower(trim(payment_status)) = 'pending' AND released_on IS NULL AND transferred_on IS NULL THEN 'EXPLICIT_PENDING' END AS evidence FROM invoices_c)
SELECT payment_status, CASE evidence WHEN 'EXPLICIT_PENDING' THEN 'OPEN' WHEN 'STATEMENT_ORIGINAL_PAYOUT' THEN 'CLOSED' WHEN 'INVOICE_FUND_TRANSFER' THEN 'CLOSED' ELSE 'UNKNOWN' END AS closure,
       evidence, count(*) AS n_orders, sum(income_c) / 100.0 AS order_income FROM t GROUP BY ALL""",
    "fact_completeness": """
SELECT CASE WHEN o.order_id IS NULL THEN 'NO_ORDER' WHEN s.order_id IS NULL THEN 'NO_FACT' ELSE 'BOTH' END AS coverage, count(*) AS n_orders
FROM orders_c o FULL JOIN facts s ON o.order_id = s.order_id GROUP BY ALL""",
    "bundle_verdicts": """
, c AS (SELECT order_id, key % 6 AS k, count(*) AS n FROM items_c GROUP BY ALL)
SELECT CASE WHEN k = 0 OR (k = 1 AND n = 1) THEN 'NEW' WHEN k IN (1, 3) THEN 'UNSAFE' WHEN k = 2 THEN 'CONFLICT' ELSE 'EXACT_DUPLICATE' END AS verdict, count(*) AS n_orders, sum(n)::BIGINT AS n_rows FROM c GROUP BY ALL""",
}
BODIES |= {
    "upsert_changes": _SNAPSHOT + """
SELECT market, order_id, new.status, CASE WHEN old.key IS NULL THEN 'INSERT' ELSE 'UPDATE' END AS action FROM new LEFT JOIN old USING (market, order_id) WHERE old.key IS NULL OR old.status <> new.status""",
    "statement_compare": """
, j AS (SELECT final_c, released_c, CASE WHEN o.order_id IS NULL THEN 'NOT_IN_ORDERS' WHEN s.order_id IS NULL THEN 'NOT_IN_STATEMENT' WHEN abs(final_c - released_c) <= 2 THEN 'MATCHED' ELSE 'DIFFERENT' END AS outcome
        FROM orders_c o FULL JOIN statements_c s ON o.order_id = s.order_id)
SELECT outcome, count(*) AS n_orders, sum(final_c) / 100.0 AS ours, sum(released_c) / 100.0 AS theirs FROM j GROUP BY outcome""",
    "order_coverage": """
SELECT market, count(*) AS n_orders, count(*) FILTER (order_id IN (SELECT order_id FROM items_c)) AS with_items, count(*) FILTER (order_id IN (SELECT order_id FROM components_c)) AS with_components,
       count(*) FILTER (order_id IN (SELECT order_id FROM statements_c)) AS with_statement, count(*) FILTER (order_id IN (SELECT order_id FROM statements_c) AND order_id IN (SELECT order_id FROM items_c)) AS with_all
FROM orders_c GROUP BY market""",
    "invoice_totals_by_day": """
SELECT market, created, count(*) AS n_orders, sum(final_c) / 100.0 AS final_amount, sum(sum(final_c)) OVER (PARTITION BY market ORDER BY created) / 100.0 AS so_far, row_number() OVER (PARTITION BY market ORDER BY created) AS day_no
FROM orders_c GROUP BY market, created""",
    "adjustment_matches": """
SELECT kind, date_trunc('month', day)::DATE AS month, order_id IN (SELECT order_id FROM orders_c) AS has_order, count(*) AS n_events, sum(amount_c) / 100.0 AS amount, count(DISTINCT order_id) AS n_orders FROM adjustments_c GROUP BY ALL""",
}
BODIES["identity_matching"] = """
, g AS (SELECT order_id, key, flag, item_index AS i, subtotal_c AS a, count(*) OVER w AS n, row_number() OVER (w ORDER BY item_index) AS r FROM items_c WINDOW w AS (PARTITION BY order_id, flag)),
e AS (SELECT x.order_id, x.flag, x.r, y.r AS j FROM g x JOIN g y USING (order_id, flag) WHERE abs(x.a + CASE WHEN x.key % 9 = 0 AND x.i = 0 THEN 100000000 ELSE 0 END - y.a) <= 1000),
walks AS (
  WITH RECURSIVE walk AS (
    SELECT order_id, flag, 1 AS r, 1 << j AS used FROM e WHERE r = 1
    UNION ALL SELECT w.order_id, w.flag, w.r + 1, w.used | (1 << e.j) FROM walk w JOIN e ON e.order_id = w.order_id AND e.flag = w.flag AND e.r = w.r + 1 AND w.used & (1 << e.j) = 0)
  SELECT order_id, flag, r AS n, count(*) AS c FROM walk GROUP BY ALL)
SELECT s.order_id, s.flag AS product_key, s.n::INT AS n_rows, s.n::INT AS n_items, coalesce(c, 0) AS n_matchings, CASE WHEN c = 1 THEN 'ITEM' WHEN c > 1 THEN 'GROUP' ELSE 'UNRESOLVED' END AS outcome
FROM (SELECT DISTINCT order_id, flag, n FROM g) s LEFT JOIN walks USING (order_id, flag, n)"""
BODIES["incremental_facts"] = BODIES["order_facts"]

SQL = {name: CANONICAL + body for name, body in BODIES.items()}
