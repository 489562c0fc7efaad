"""Queries of billing, statement state and order reconciliation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.operators import billing, changes, reconciliation
from tallymill.plans import relations as r
from tallymill.plans.oracle import CANONICAL
from tallymill.plans.queries import query
from tallymill.sources import canonical as c
from tallymill.sources.stored import stored
from tallymill.workers import find_library


@query
def committed_periods(spark: SparkSession, d: str) -> DataFrame:
    """Committed batches with their period and what is wrong with them."""
    return billing.periods(r.statement_rows(spark, d))


@query
def committed_facts(spark: SparkSession, d: str) -> DataFrame:
    """Statement rows that passed and are committed, against all, per validation and commit state."""
    rows = r.statement_rows(spark, d)
    kept = billing.committed(rows).select("order_id", F.lit(True).alias("used"))
    return rows.join(kept, "order_id", "left").groupBy("validation", "commit", F.coalesce("used", F.lit(False)).alias("used")).agg(F.count("*").alias("n_orders"), F.sum("released").alias("released"))


def _billed(spark: SparkSession, d: str) -> DataFrame:
    scope = billing.committed(r.statement_rows(spark, d)).select("order_id", "batch_id", "period_from", "period_to")
    m = c.master(spark, d).select("sku", F.col("parent").alias("nav"), F.col("unit_price").alias("price"))
    alive = c.orders(spark, d).where("status != 'Cancelled'").select("order_id")
    promotion = F.when(F.col("flag") == "R", F.col("order_id"))
    return c.items(spark, d).join(scope, "order_id").join(alive, "order_id", "left_semi").join(m, "sku").select("batch_id", "period_from", "period_to", "nav", "sku", "price", "quantity", F.col("subtotal").alias("amount"), promotion.alias("promotion"), "order_id", "item_index")


@query
def billing_rows(spark: SparkSession, d: str) -> DataFrame:
    """Billing rows of every batch, numbered."""
    return billing.summary(_billed(spark, d), ["nav", "sku", "price"], ["batch_id"])


@query
def billing_totals(spark: SparkSession, d: str) -> DataFrame:
    return billing.totals(_billed(spark, d), ["batch_id"])


@query
def billing_control_violations(spark: SparkSession, d: str) -> DataFrame:
    """Batches whose billing rows don't add up to their items: none."""
    items = _billed(spark, d)
    return billing.controls(items, billing.summary(items, ["nav", "sku", "price"], ["batch_id"]), ["batch_id"]).select("batch_id", F.array_join("wrong", ",").alias("wrong"))


@query
def staging_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows for the ledger system, by batch: quantities per nav, sku and price, with reference and description."""
    items = _billed(spark, d)
    rows = billing.summary(items, ["nav", "sku", "price"], ["batch_id", "period_from", "period_to"])
    rows = rows.withColumns({"reference": billing.period_reference(F.col("period_from"), F.col("period_to")), "uom": F.when(F.col("sku").cast("long") % 2 == 0, "PC")})
    m = c.master(spark, d).select(F.col("parent").alias("nav"), F.when(F.col("parent").isin("Brand#11", "Brand#23"), F.lit("Goods of one kind")).otherwise(F.col("product")).alias("description"))
    return billing.staging(rows, billing.descriptions(m), ["batch_id"])


@query
def sku_summary(spark: SparkSession, d: str) -> DataFrame:
    """All platforms' rows per SKU; anything missing leaves its figure missing."""
    key = F.col("order_id").cast("long")
    m = c.master(spark, d).select("sku", "parent", F.col("product").alias("name"), "unit_price")
    rows = c.items(spark, d).join(m, "sku").select(
        "sku",
        (key * 10 + F.col("item_index")).alias("position"),
        F.when(key % 2 == 0, F.col("name")).otherwise(F.upper("name")).alias("product"),
        F.when((F.col("sku").cast("long") % 3 == 0) & (key % 40 == 1), None).otherwise(F.col("unit_price")).alias("price"),
        "quantity",
        F.when((F.col("sku").cast("long") % 5 == 0) & (key % 40 == 2), None).otherwise(F.col("subtotal")).alias("value"),
        F.when((F.col("sku").cast("long") % 7 == 0) & (key % 40 == 3), None).when((F.col("sku").cast("long") % 11 == 0) & (key % 2 == 0), "other").otherwise(F.col("parent")).alias("nav"),
    )
    return billing.sku_summary(rows)


def _incoming_events(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = c.adjustments(spark, d).withColumn("platform", F.lit("Shopee"))
    facts = ["platform", "order_id", "kind", "day", "amount"]
    known = rows.where(F.col("day") <= F.lit("2024-01-15").cast("date"))
    events = rows.withColumn("amount", F.when(F.col("event_id") % 10 == 0, F.col("amount") + 1).otherwise(F.col("amount")).cast(r.MONEY))
    return events.withColumn("fingerprint", changes.row_hash(facts)), known.withColumn("fingerprint", changes.row_hash(facts))


@query
def event_classes(spark: SparkSession, d: str) -> DataFrame:
    """Incoming adjustments against committed ones: new, known or in conflict."""
    events, committed = _incoming_events(spark, d)
    rows = changes.classify_events(events, committed, "fingerprint", ["platform", "order_id", "kind", "day"], ["event_id"])
    return rows.groupBy("kind", "outcome").agg(F.count("*").alias("n_events"), F.sum("amount").alias("amount"))


def _bundle_verdicts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Component rows of a statement and their verdicts against the committed ones, zeros of unknown fees aside.

    Both sides are views of one ledger that is stored by order, and so are the verdicts: nothing is shuffled after the ledger.
    """
    key = F.col("order_id").cast("long")
    batch = F.concat(F.lit("b"), (key % 4).cast("string"))
    ledger = stored(c.ledger(spark, d).select("order_id", "components"), "bundle-ledger", "order_id")
    fee = F.array(F.struct(F.lit("Optional Fee").alias("name"), F.lit("0.00").cast(r.MONEY).alias("amount")))
    rows = ledger.select("order_id", F.inline(F.concat("components", fee))).withColumn("batch_id", batch)
    headers = spark.createDataFrame([("b0", ["Transaction Fee"]), ("b1", ["Transaction Fee"]), ("b2", ["Transaction Fee", "Optional Fee"])], "batch_id string, names array<string>")
    rows = changes.without_absent_zeros(rows, F.broadcast(headers), F.col("name") == "Optional Fee")
    changed = F.when((key % 6 == 1) & (F.col("name") == "Discount"), F.col("amount") - 1).otherwise(F.col("amount")).cast(r.MONEY)
    old = ledger.select("order_id", F.inline("components")).withColumn("batch_id", batch).where((key % 6 != 2) & ~((key % 6 == 3) & (F.col("name") == "Transaction Fee"))).withColumn("amount", changed)
    return rows, stored(changes.classify_bundles(old, rows, "order_id", ["name", "amount"], ["name"]), "bundle-verdicts", "order_id")


@query
def component_bundles(spark: SparkSession, d: str) -> DataFrame:
    """Orders' components against committed ones, by batch: a zero that the other side can't have is no difference."""
    rows, verdicts = _bundle_verdicts(spark, d)
    return verdicts.join(rows.select("order_id", "batch_id").distinct(), "order_id").groupBy("batch_id", "verdict").agg(F.count("*").alias("n_orders"), F.sum("n_rows").alias("n_rows"))


@query
def statement_preflight(spark: SparkSession, d: str) -> DataFrame:
    """One row: may the statement be written, and what of it is new."""
    events, committed = _incoming_events(spark, d)
    classes = changes.classify_events(events, committed, "fingerprint", ["platform", "order_id", "kind", "day"], ["event_id"])
    rows, verdicts = _bundle_verdicts(spark, d)
    plan = changes.write_plan(rows, verdicts, "order_id").agg(F.count("*").alias("n_planned_rows"), F.sum("amount").alias("planned_amount"))
    return changes.preflight(verdicts, classes).join(F.broadcast(plan))  # one row each


@query
def statement_issues(spark: SparkSession, d: str) -> DataFrame:
    """A statement's orders by what its control sums say: item rows against components, components against what was released."""
    skus = c.items(spark, d).groupBy("order_id").agg(F.sum("original").alias("sku_total"), F.count("*").alias("n_skus"))
    own = c.ledger(spark, d).join(skus, "order_id", "full_outer")
    total = F.aggregate("components", F.lit(0).cast(r.MONEY), lambda acc, x: (acc + x["amount"]).cast(r.MONEY))
    off = lambda a, b: F.coalesce(F.abs(a - b) > r.cents(2), F.lit(False))
    issues = F.array_compact(
        F.array(
            F.when(F.col("released").isNull(), "NO_ORDER_ROW"),
            F.when(F.col("n_skus").isNull(), "NO_SKU_ROWS"),
            F.when(off(F.col("sku_total"), F.col("product")), "SKU_TOTAL"),
            F.when(off(F.col("released"), total), "RELEASED_TOTAL"),
            F.when(F.col("refund").isNotNull() & (F.col("refund") > 0), "REFUND_SIGN"),
        )
    )
    return own.groupBy(F.array_join(issues, ",").alias("issues")).agg(F.count("*").alias("n_orders"), F.sum("released").alias("released"), F.sum("sku_total").alias("sku_total"))


@query
def statement_components(spark: SparkSession, d: str) -> DataFrame:
    """The component ledger of all record types: orders, item rows, service fee details and shipping; missing amounts have no row."""
    orders = c.components(spark, d).select(F.lit("ORDER").alias("record_type"), "name", "amount")
    pairs = lambda *of: F.inline(F.array(*(F.struct(F.lit(n).alias("name"), a.cast(r.MONEY).alias("amount")) for n, a in of)))
    refunded = F.when((F.col("flag") == "R") & (F.col("quantity") >= 40), -F.col("subtotal"))
    skus = c.items(spark, d).select(F.lit("SKU").alias("record_type"), pairs(("Product Price", F.col("original")), ("Discount", F.col("subtotal") - F.col("original")), ("Refund Amount", refunded)))
    ledger = c.ledger(spark, d).where("released IS NOT NULL")
    fees = ledger.select(F.lit("SERVICE_FEE_DETAIL").alias("record_type"), pairs(("Service Fee", F.col("fee")), ("Campaign Fee", F.when(F.col("order_id").cast("long") % 3 == 0, r.cents(-150)))))
    shipping = ledger.where(F.col("order_id").cast("long") % 10 == 0).select(F.lit("SHIPPING_FEE_DISCREPANCY").alias("record_type"), pairs(("Expected Shipping Fee", r.cents(500)), ("Actual Shipping Fee", F.when(F.col("order_id").cast("long") % 20 == 0, r.cents(650)))))
    rows = orders.unionByName(skus).unionByName(fees).unionByName(shipping).where("amount IS NOT NULL")
    return rows.groupBy("record_type", "name").agg(F.count("*").alias("n_rows"), F.sum("amount").alias("amount"))


def _identities(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(statement rows, order items, the rows' identities), each computed once."""
    find_library(spark)
    rows, items, families = reconciliation.stored_keys(*r.family_rows(spark, d))
    return rows, items, stored(reconciliation.identities(rows, items, families), "identities", "order_id")


@query
def family_matching(spark: SparkSession, d: str) -> DataFrame:
    """Statement rows by how they found their item: promotion group, family and names, amounts, or the order's graph."""
    found = _identities(spark, d)[2]
    return found.groupBy("scope", "diagnostic").agg(F.count("*").alias("n_rows"), F.countDistinct("order_id").alias("n_orders"), F.sum("n_matchings").alias("n_matchings"), F.sum(F.size("members")).cast("long").alias("n_members"))


@query
def promotion_product_groups(spark: SparkSession, d: str) -> DataFrame:
    """The product groups that their source proves as a whole: order, product, members, ways to pair them off."""
    find_library(spark)
    rows, items, families = reconciliation.stored_keys(*r.family_rows(spark, d))
    family = stored(reconciliation.family_items(rows, items, families), "family-items", "order_id")
    pairs = stored(reconciliation.edges(rows, items, family), "family-edges", "order_id")
    found = reconciliation.promotion_groups(rows, items, family, pairs)
    return found.select("order_id", "product_id", F.array_join("members", ",").alias("members"), "n_matchings")


@query
def identity_assignments(spark: SparkSession, d: str) -> DataFrame:
    """The rows that an order's graph decides, with the item or the group that each gets."""
    found = _identities(spark, d)[2].where("diagnostic IN ('ONE_ALLOCATION', 'SEVERAL_ALLOCATIONS')")
    return found.select("order_id", "product_id", "row_no", "scope", "item_index", F.array_join("members", ",").alias("members"), "n_matchings")


@query
def merchandise_components(spark: SparkSession, d: str) -> DataFrame:
    """Money of each order's connected components of rows, items and promotions, compared."""
    rows, items, identities = _identities(spark, d)
    found = reconciliation.merchandise(rows, items, reconciliation.pairs_of(identities))
    return found.select(F.split("scope_key", ":")[0].alias("scope"), "reconciled", "n_rows", "n_items", "difference").groupBy("scope", "reconciled").agg(F.count("*").alias("n_components"), F.sum("n_rows").alias("n_rows"), F.sum("n_items").alias("n_items"), F.sum("difference").alias("difference"))


@query
def identity_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Orders by whether every row and item is covered, and whether an item is claimed twice."""
    out = reconciliation.coverage(*_identities(spark, d))
    return out.groupBy((F.col("n_covered_rows") == F.col("n_rows")).alias("rows_covered"), (F.col("n_covered_items") == F.col("n_items")).alias("items_covered"), (F.col("n_claimed_twice") > 0).alias("claimed_twice"), (F.col("n_overlapping") > 0).alias("overlapping")).agg(F.count("*").alias("n_orders"), F.sum("n_items").alias("n_items"))


_STATEMENT = """
, sr0 AS (SELECT order_id, key, date_trunc('week', payout)::DATE AS period_from, payout, released_c, CASE WHEN key % 23 = 0 THEN 'PENDING' ELSE 'COMMITTED' END AS "commit", CASE WHEN key % 29 = 0 THEN 'FAILED' ELSE 'PASSED' END AS validation
         FROM statements_c JOIN orders_c USING (order_id)),
sr AS (SELECT *, period_from - DATE '1990-01-01' AS no, 'b' || (period_from - DATE '1990-01-01') AS batch_id, period_from + 6 AS period_to, count(*) FILTER ("commit" = 'COMMITTED') OVER (PARTITION BY period_from) + CASE WHEN (period_from - DATE '1990-01-01') % 13 = 0 THEN 1 ELSE 0 END AS order_count FROM sr0),
billed AS (SELECT batch_id, period_from, period_to, parent AS nav, sku, price_c, quantity, subtotal_c, CASE WHEN flag = 'R' THEN i.order_id END AS promotion
           FROM items_c i JOIN sr USING (order_id) JOIN orders_c o USING (order_id) JOIN master_c USING (sku) WHERE validation = 'PASSED' AND "commit" = 'COMMITTED' AND o.status <> 'Cancelled'),
br AS (SELECT batch_id, period_from, period_to, nav, sku, price_c, sum(quantity)::BIGINT AS quantity, sum(subtotal_c) AS a, count(*) AS n_items, row_number() OVER (PARTITION BY batch_id ORDER BY lower(nav), sku, price_c) AS number FROM billed GROUP BY batch_id, period_from, period_to, nav, sku, price_c)
"""
_EVENTS = """
, ie AS (SELECT *, CASE WHEN event_id % 10 = 0 THEN amount_c + 100 ELSE amount_c END AS a, day <= DATE '2024-01-15' AS old FROM adjustments_c),
ev AS (SELECT x.*, row_number() OVER (PARTITION BY order_id, kind, day, a ORDER BY event_id) > 1 AS again, EXISTS (SELECT 1 FROM ie y WHERE y.old AND y.order_id = x.order_id AND y.kind = x.kind AND y.day = x.day AND y.amount_c = x.a) AS known,
              EXISTS (SELECT 1 FROM ie y WHERE y.old AND y.order_id = x.order_id AND y.kind = x.kind AND y.day = x.day) AS same FROM ie x),
ec AS (SELECT *, CASE WHEN again OR known THEN 'SKIPPED' WHEN same THEN 'CONFLICT' ELSE 'NEW' END AS outcome FROM ev)
"""
_BUNDLES = """
, bn AS (SELECT order_id, key, key % 4 AS b, CASE WHEN refund IS NULL THEN 3 ELSE 4 END + CASE WHEN key % 4 IN (0, 1) THEN 0 ELSE 1 END AS n, product + discount + fee + coalesce(refund, 0) AS total FROM sums),
bv AS (SELECT *, CASE WHEN key % 6 = 2 THEN 'NEW' WHEN b > 1 OR key % 6 = 3 THEN 'UNSAFE' WHEN key % 6 = 1 THEN 'CONFLICT' ELSE 'EXACT_DUPLICATE' END AS verdict FROM bn)
"""
_FAMILY = """
, fi AS (SELECT i.order_id, i.key, item_index, part, part % 40 AS g, CASE WHEN part % 9 <> 0 THEN 'S' || (part % 40) ELSE '' END AS sku, CASE WHEN (i.key + item_index) % 11 = 0 THEN 'Renamed ' ELSE 'Item ' END || (part % 40 % 12) AS name,
                'v' || (part % 40 // 12) AS variation, 'n' || (part % 40) AS nav, CASE WHEN i.key % 20 <> 3 THEN quantity END AS quantity, 1000 + 100 * (part % 40) AS unit_c, subtotal_c,
                CASE WHEN flag = 'R' AND i.key % 2 = 0 THEN i.order_id || '/R' END AS promotion, CASE WHEN flag = 'R' AND i.key % 2 = 0 AND i.key % 16 <> 6 THEN sum(subtotal_c) OVER (PARTITION BY i.order_id, flag) END AS group_c
         FROM items_c i),
fr AS (SELECT order_id, key, item_index AS row_no, CASE WHEN key % 17 = 0 AND item_index = 1 THEN 'PX' ELSE 'P' || (g % 12) END AS pid,
              CASE WHEN (key + item_index) % 7 = 0 THEN 'other Item ' WHEN (key + item_index) % 3 = 0 THEN 'ITEM  ' ELSE 'Item ' END || (g % 12) AS name, subtotal_c + CASE WHEN key % 10 = 3 THEN 3 ELSE 0 END AS price_c
       FROM fi WHERE key % 12 <> 5 OR item_index <> 0),
listed AS (SELECT DISTINCT part % 40 AS g FROM master_c),
fam AS (SELECT 'P' || f AS pid, CASE WHEN g % 5 = 4 THEN 'M' ELSE 'S' END || g AS sku, CASE WHEN g % 5 = 4 THEN 'S' || g ELSE 'K' || (g % 12) END AS parent_sku, 'item ' || (g % 12) AS name_key, 'v' || (g // 12) AS variation, CASE WHEN g % 13 = 5 THEN 'x' ELSE 'n' || g END AS nav, 1000 + 100 * g AS price_c
        FROM (SELECT g, unnest(CASE WHEN g % 10 = 7 THEN [g % 12, (g + 1) % 12] ELSE [g % 12] END) AS f FROM listed)),
ties AS (
  SELECT order_id, item_index, pid, 0 AS tier, name_key, f.nav = i.nav AND f.variation = i.variation AND price_c = unit_c AS agrees FROM fi i JOIN fam f ON i.sku <> '' AND i.sku = f.sku
  UNION ALL SELECT order_id, item_index, pid, 1, name_key, f.nav = i.nav AND f.variation = i.variation AND price_c = unit_c FROM fi i JOIN fam f ON i.sku <> '' AND i.sku = f.parent_sku
  UNION ALL SELECT order_id, item_index, pid, 2, name_key, f.nav = i.nav AND price_c = unit_c FROM fi i JOIN fam f ON lower(i.name) = f.name_key AND i.variation = f.variation),
linked AS (SELECT t.* FROM ties t JOIN (SELECT DISTINCT order_id, pid FROM fr) USING (order_id, pid)),
first_tier AS (SELECT order_id, pid, min(tier) AS tier FROM linked GROUP BY ALL),
claims AS (SELECT order_id, item_index, count(DISTINCT pid) AS n_products FROM linked GROUP BY ALL),
fm AS (SELECT order_id, pid, item_index, list(DISTINCT name_key) AS names, bool_and(agrees) AS agrees, any_value(n_products) AS n_products FROM linked JOIN first_tier USING (order_id, pid, tier) JOIN claims USING (order_id, item_index) GROUP BY ALL),
fe0 AS (SELECT r.order_id, r.pid, r.row_no, m.item_index, r.price_c, i.subtotal_c, i.promotion IS NOT NULL AS promoted, r.name = i.name AS same, lower(regexp_replace(r.name, ' +', ' ', 'g')) AS key_name, lower(i.name) AS item_key, names
        FROM fr r JOIN fm m USING (order_id, pid) JOIN fi i ON i.order_id = m.order_id AND i.item_index = m.item_index),
fe AS (SELECT *, same OR key_name = item_key AS named, same OR key_name = item_key OR list_contains(names, key_name) AS compatible FROM fe0),
fn AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (named) OVER w AS n_named FROM fe WHERE compatible WINDOW w AS (PARTITION BY order_id, row_no)),
fw AS (SELECT *, count(*) FILTER ((n_named = 0 OR named) AND abs(price_c - subtotal_c) <= 2) OVER w AS n_near, count(*) FILTER ((n_named = 0 OR named) AND promoted) OVER w AS n_promoted FROM fn WINDOW w AS (PARTITION BY order_id, row_no)),
fc AS (SELECT order_id, pid, row_no, item_index, n = 1 OR (n_named = 1 AND named) OR (n_named <> 1 AND n_promoted = 0 AND n_near = 1 AND (n_named = 0 OR named) AND abs(price_c - subtotal_c) <= 2) AS preferred FROM fw),
-- products as lists: their family's items, and each row's items as bits of that list
gi AS (SELECT order_id, pid, list(item_index ORDER BY item_index)::BIGINT[] AS members, count(*) AS k, bool_or(promotion IS NOT NULL) AND bool_and(agrees AND n_products = 1 AND quantity > 0 IS TRUE AND CASE WHEN promotion IS NOT NULL THEN group_c IS NOT NULL ELSE subtotal_c IS NOT NULL END)
              AND count(DISTINCT (sku, nav, variation, unit_c)) = 1 AND min(sku) <> '' AND count(*) > 1 AS proven FROM fm JOIN fi USING (order_id, item_index) GROUP BY ALL),
gr AS (SELECT order_id, pid, row_no, list(item_index) AS near, count(*) FILTER (preferred) AS n_preferred, max(item_index) FILTER (preferred) AS chosen FROM fc GROUP BY ALL),
gm AS (SELECT order_id, pid, any_value(members) AS members, any_value(k) AS k, any_value(proven) AS proven, count(*) AS n_edged, list(list_sum(list_transform(near, lambda x: 1 << (list_position(members, x) - 1)))::BIGINT ORDER BY row_no) AS masks, sum(n_preferred) AS n_preferred, count(DISTINCT chosen) AS n_chosen
       FROM gr JOIN gi USING (order_id, pid) GROUP BY ALL),
gn AS (SELECT *, list_bit_or(masks) AS used FROM gm JOIN (SELECT order_id, pid, count(*) AS n_rows FROM fr GROUP BY ALL) USING (order_id, pid) WHERE proven AND n_edged = n_rows),
gw AS (SELECT *, CASE WHEN bit_count(used) <> n_rows THEN 0 ELSE list_reduce(list_transform(masks, lambda x: [x]), lambda w, x: list_transform(range(1::BIGINT << k), lambda m: list_sum(list_transform(range(k), lambda i: CASE WHEN (x[1] & m & (1 << i)) <> 0 THEN w[m - (1 << i) + 1] ELSE 0 END))::BIGINT), list_transform(range(1::BIGINT << k), lambda m: (m = 0)::BIGINT))[used + 1] END AS n_matchings FROM gn),
pg AS (SELECT order_id, pid, members, n_matchings FROM gw WHERE NOT (n_preferred = n_rows AND n_rows = k AND n_chosen = k) AND NOT (n_rows = k AND bit_count(used) = k AND (n_matchings = 1 OR (n_matchings >= 2 AND n_preferred = 0)))),
rest AS (SELECT * FROM fc ANTI JOIN pg USING (order_id, pid)),
pref AS (SELECT order_id, pid, row_no, item_index FROM rest WHERE preferred),
gone AS (SELECT order_id, bit_or(1::BIGINT << item_index) AS mask FROM (SELECT order_id, unnest(members) AS item_index FROM pg UNION ALL SELECT order_id, item_index FROM pref) GROUP BY ALL),
-- an order's open products as lists [number of items, the items, each row's items as bits], folded in the order of their ids
op AS (SELECT order_id, pid, any_value(members) AS members, list(list_sum(list_transform(near, lambda x: 1 << (list_position(members, x) - 1)))::BIGINT ORDER BY row_no) AS masks FROM gr JOIN gi USING (order_id, pid) WHERE n_preferred = 0 AND (order_id, pid) NOT IN (SELECT (order_id, pid) FROM pg) GROUP BY ALL),
oo AS (SELECT order_id, list(list_concat([len(members)::BIGINT], members, masks) ORDER BY pid) AS products, list(pid ORDER BY pid) AS pids FROM op GROUP BY ALL),
fold AS (SELECT order_id, pids, list_reduce(products, lambda s, p:
    list_transform([list_sum(list_transform(range(1, p[1] + 1), lambda i: CASE WHEN (s[1] >> p[i + 1]) & 1 = 0 THEN 1::BIGINT << (i - 1) ELSE 0 END))::BIGINT], lambda a:
      list_transform([list_bit_or(list_transform(p[p[1] + 2:], lambda x: x & a))], lambda u:
        list_transform([CASE WHEN bit_count(u) <> len(p) - p[1] - 1 THEN 0 ELSE list_reduce(list_transform(p[p[1] + 2:], lambda x: [x & a]), lambda w, x: list_transform(range(1::BIGINT << p[1]), lambda m: list_sum(list_transform(range(p[1]), lambda i: CASE WHEN (x[1] & m & (1::BIGINT << i)) <> 0 THEN w[m - (1::BIGINT << i) + 1] ELSE 0 END))::BIGINT), list_transform(range(1::BIGINT << p[1]), lambda m: (m = 0)::BIGINT))[u + 1] END], lambda n:
          list_transform([list_sum(list_transform(range(1, p[1] + 1), lambda i: ((u >> (i - 1)) & 1) << p[i + 1]))::BIGINT], lambda taken:
            list_concat([s[1] | CASE WHEN n > 0 THEN taken ELSE 0 END], s[2:], [n, taken]))[1])[1])[1])[1], [coalesce(mask, 0)]) AS s FROM oo LEFT JOIN gone USING (order_id)),
tried AS (SELECT order_id, unnest(pids) AS pid, unnest(list_transform(range(1, len(pids) + 1), lambda i: s[2 * i])) AS n, unnest(list_transform(range(1, len(pids) + 1), lambda i: s[2 * i + 1])) AS taken FROM fold),
-- the one way to pair off, row by row
tr AS (SELECT g.order_id, g.pid, row_no, near, taken, row_number() OVER (PARTITION BY g.order_id, g.pid ORDER BY row_no) AS nth, count(*) OVER (PARTITION BY g.order_id, g.pid) AS n_rows FROM gr g JOIN tried t ON t.order_id = g.order_id AND t.pid = g.pid WHERE n = 1 AND n_preferred = 0),
one_way AS (
  WITH RECURSIVE walk AS (
    SELECT order_id, pid, 0::BIGINT AS nth, taken AS left_, []::BIGINT[] AS way FROM tr WHERE nth = 1
    UNION ALL SELECT w.order_id, w.pid, t.nth, w.left_ - (1::BIGINT << x.i), list_append(w.way, x.i) FROM walk w JOIN tr t ON t.order_id = w.order_id AND t.pid = w.pid AND t.nth = w.nth + 1, unnest(t.near) AS x(i) WHERE (w.left_ >> x.i) & 1 = 1)
  SELECT order_id, pid, way FROM walk WHERE left_ = 0),
ids AS (
  SELECT order_id, pid, row_no, 'GROUP' AS scope, NULL::BIGINT AS item_index, members, n_matchings, 'PROMOTION_GROUP' AS diagnostic FROM fr JOIN pg USING (order_id, pid)
  UNION ALL SELECT order_id, pid, row_no, 'ITEM', item_index, [item_index]::BIGINT[], 1, 'PREFERRED' FROM pref
  UNION ALL SELECT t.order_id, t.pid, row_no, 'ITEM', way[nth], [way[nth]], 1, 'ONE_ALLOCATION' FROM tr t JOIN one_way w ON w.order_id = t.order_id AND w.pid = t.pid
  UNION ALL SELECT g.order_id, g.pid, row_no, CASE WHEN n > 1 THEN 'GROUP' ELSE 'UNRESOLVED' END, NULL, CASE WHEN n > 1 THEN list_filter(range(63), lambda i: (taken >> i) & 1 = 1) ELSE [] END, n, CASE WHEN n > 1 THEN 'SEVERAL_ALLOCATIONS' ELSE 'NO_ALLOCATION' END
            FROM gr g JOIN tried t ON t.order_id = g.order_id AND t.pid = g.pid WHERE n <> 1 AND n_preferred = 0),
every_id AS (SELECT * FROM ids UNION ALL SELECT order_id, pid, row_no, 'UNRESOLVED', NULL, [], 0, CASE WHEN (order_id, row_no) IN (SELECT (order_id, row_no) FROM fe) THEN 'NAME_CONFLICT' ELSE 'NO_CANDIDATE' END FROM fr WHERE (order_id, row_no) NOT IN (SELECT (order_id, row_no) FROM ids)),
pairs AS (SELECT order_id, row_no, unnest(members) AS item_index FROM ids)
"""

BODIES = {
    "committed_periods": _STATEMENT + """
, b AS (SELECT batch_id, count(DISTINCT CASE WHEN no % 11 = 0 AND key % 2 = 0 THEN 'other' ELSE 'h' END) AS facts, max(period_from) AS period_from, max(period_to) AS period_to, count(*) AS n_orders, max(order_count) AS declared, sum(released_c) AS rel FROM sr WHERE "commit" = 'COMMITTED' GROUP BY batch_id)
SELECT batch_id, period_from, period_to, n_orders, declared, rel / 100.0 AS released, CASE WHEN facts > 1 THEN 'CONFLICTING_FACTS' WHEN n_orders <> declared THEN 'COUNT_MISMATCH' END AS problem FROM b""",
    "committed_facts": _STATEMENT + """SELECT validation, "commit", validation = 'PASSED' AND "commit" = 'COMMITTED' AS used, count(*) AS n_orders, sum(released_c) / 100.0 AS released FROM sr GROUP BY ALL""",
    "billing_rows": _STATEMENT + "SELECT batch_id, nav, sku, price_c / 100.0 AS price, quantity, a / 100.0 AS amount, n_items, (price_c * quantity - a) / 100.0 AS discount, number FROM br",
    "billing_totals": _STATEMENT + """
SELECT batch_id, sum(subtotal_c) FILTER (promotion IS NULL) / 100.0 AS normal_amount, sum(subtotal_c) FILTER (promotion IS NOT NULL) / 100.0 AS promotion_amount, count(DISTINCT promotion) AS n_promotions, count(*) FILTER (promotion IS NULL) AS n_normal, sum(quantity)::BIGINT AS quantity FROM billed GROUP BY batch_id""",
    "billing_control_violations": _STATEMENT + "SELECT batch_id, 'AMOUNT' AS wrong FROM (SELECT batch_id, sum(subtotal_c) AS x FROM billed GROUP BY batch_id) JOIN (SELECT batch_id, sum(a) AS y FROM br GROUP BY batch_id) USING (batch_id) WHERE x <> y",
    "staging_rows": _STATEMENT + """
, ds AS (SELECT parent AS nav, CASE WHEN count(DISTINCT CASE WHEN parent IN ('Brand#11', 'Brand#23') THEN 'Goods of one kind' ELSE product END) = 1 THEN max(CASE WHEN parent IN ('Brand#11', 'Brand#23') THEN 'Goods of one kind' ELSE product END) END AS description FROM master_c GROUP BY parent)
SELECT batch_id, nav, sku, price_c / 100.0 AS price, quantity, 'SP' || strftime(period_from, '%Y%m%d') || strftime(period_to, '%m%d') AS reference, FALSE AS conflict, coalesce(description, 'MISSING') AS description, number AS line FROM br LEFT JOIN ds USING (nav)""",
    "sku_summary": """
, x AS (SELECT sku, i.key * 10 + item_index AS pos, CASE WHEN i.key % 2 = 0 THEN product ELSE upper(product) END AS product, CASE WHEN part % 3 = 0 AND i.key % 40 = 1 THEN NULL ELSE price_c END AS p, quantity, CASE WHEN part % 5 = 0 AND i.key % 40 = 2 THEN NULL ELSE subtotal_c END AS v,
               CASE WHEN part % 7 = 0 AND i.key % 40 = 3 THEN NULL WHEN part % 11 = 0 AND i.key % 2 = 0 THEN 'other' ELSE parent END AS nav FROM items_c i JOIN master_c USING (sku, part)),
f AS (SELECT sku, string_agg(product, ' | ' ORDER BY first) AS product FROM (SELECT sku, product, min(pos) AS first FROM x GROUP BY ALL) GROUP BY sku),
g AS (SELECT sku, sum(quantity)::BIGINT AS quantity, CASE WHEN count(*) = count(p) AND count(DISTINCT p) = 1 THEN max(p) END AS p, CASE WHEN count(*) = count(v) THEN sum(v) END AS v, CASE WHEN count(DISTINCT nav) > 1 THEN 'Conflict' WHEN count(*) > count(nav) THEN 'N/A' ELSE max(nav) END AS nav FROM x GROUP BY sku)
SELECT sku, product, quantity, p / 100.0 AS price, v / 100.0 AS value, nav, (p * quantity - v) / 100.0 AS discount FROM g JOIN f USING (sku)""",
    "event_classes": _EVENTS + "SELECT kind, outcome, count(*) AS n_events, sum(a) / 100.0 AS amount FROM ec GROUP BY ALL",
    "component_bundles": _BUNDLES + "SELECT 'b' || b AS batch_id, verdict, count(*) AS n_orders, sum(n)::BIGINT AS n_rows FROM bv GROUP BY ALL",
    "statement_preflight": _EVENTS + _BUNDLES + """
, o AS (SELECT count(*) FILTER (verdict = 'NEW') AS n_new, count(*) FILTER (verdict = 'EXACT_DUPLICATE') AS n_duplicate, count(*) FILTER (verdict = 'CONFLICT') AS n_conflict, count(*) FILTER (verdict = 'UNSAFE') AS n_unsafe, sum(n) FILTER (verdict = 'NEW') AS n_planned_rows, sum(total) FILTER (verdict = 'NEW') / 100.0 AS planned_amount FROM bv),
e AS (SELECT count(*) FILTER (outcome = 'NEW') AS n_events_new, count(*) FILTER (outcome = 'SKIPPED') AS n_events_skipped, count(*) FILTER (outcome = 'CONFLICT') AS n_events_conflict FROM ec)
SELECT o.* REPLACE (n_planned_rows::BIGINT AS n_planned_rows), e.*, CASE WHEN n_conflict > 0 OR n_events_conflict > 0 THEN 'CONFLICT' WHEN n_unsafe > 0 THEN 'INCOMPLETE_UNSAFE' WHEN n_new = 0 AND n_events_new = 0 THEN 'ALREADY_IMPORTED' WHEN n_duplicate > 0 OR n_events_skipped > 0 THEN 'MIXED' ELSE 'NEW' END AS status FROM o, e""",
    "statement_issues": """
, x AS (SELECT s.*, released_c, CASE WHEN released_c IS NULL THEN 'NO_ORDER_ROW' WHEN s.key % 7 = 0 THEN 'RELEASED_TOTAL' ELSE '' END AS issues FROM sums s LEFT JOIN statements_c USING (order_id))
SELECT issues, count(*) AS n_orders, sum(released_c) / 100.0 AS released, sum(product) / 100.0 AS sku_total FROM x GROUP BY issues""",
    "statement_components": """
, x AS (SELECT 'ORDER' AS record_type, name, amount_c FROM components_c UNION ALL SELECT 'SKU', 'Product Price', original_c FROM items_c UNION ALL SELECT 'SKU', 'Discount', subtotal_c - original_c FROM items_c
        UNION ALL SELECT 'SKU', 'Refund Amount', -subtotal_c FROM items_c WHERE flag = 'R' AND quantity >= 40
        UNION ALL SELECT 'SERVICE_FEE_DETAIL', 'Service Fee', fee FROM sums WHERE key % 7 <> 2 UNION ALL SELECT 'SERVICE_FEE_DETAIL', 'Campaign Fee', -150 FROM sums WHERE key % 7 <> 2 AND key % 3 = 0
        UNION ALL SELECT 'SHIPPING_FEE_DISCREPANCY', 'Expected Shipping Fee', 500 FROM sums WHERE key % 7 <> 2 AND key % 10 = 0 UNION ALL SELECT 'SHIPPING_FEE_DISCREPANCY', 'Actual Shipping Fee', 650 FROM sums WHERE key % 7 <> 2 AND key % 20 = 0)
SELECT record_type, name, count(*) AS n_rows, sum(amount_c) / 100.0 AS amount FROM x GROUP BY ALL""",
    "family_matching": _FAMILY + "SELECT scope, diagnostic, count(*) AS n_rows, count(DISTINCT order_id) AS n_orders, sum(n_matchings)::BIGINT AS n_matchings, sum(len(members))::BIGINT AS n_members FROM every_id GROUP BY ALL",
    "promotion_product_groups": _FAMILY + "SELECT order_id, pid AS product_id, array_to_string(members, ',') AS members, n_matchings FROM pg",
    "identity_assignments": _FAMILY + "SELECT order_id, pid AS product_id, row_no, scope, item_index, array_to_string(members, ',') AS members, n_matchings FROM ids WHERE diagnostic IN ('ONE_ALLOCATION', 'SEVERAL_ALLOCATIONS')",
    "identity_coverage": _FAMILY + """
, o AS (SELECT order_id, count(*) AS n_items FROM fi GROUP BY ALL), a AS (SELECT order_id, count(*) AS n_rows, count(*) FILTER (scope <> 'UNRESOLVED') AS n_cov FROM every_id GROUP BY ALL),
cl AS (SELECT order_id, count(*) AS n_ci, count(*) FILTER (k > 1) AS twice, count(*) FILTER (k > 0 AND grouped > 0) AS n_overlap FROM (SELECT order_id, item, count(*) FILTER (scope = 'ITEM') AS k, count(*) FILTER (scope = 'GROUP') AS grouped FROM (SELECT order_id, scope, unnest(members) AS item FROM ids) GROUP BY ALL) GROUP BY ALL)
SELECT coalesce(n_cov, 0) = coalesce(n_rows, 0) AS rows_covered, coalesce(n_ci, 0) = n_items AS items_covered, coalesce(twice, 0) > 0 AS claimed_twice, coalesce(n_overlap, 0) > 0 AS overlapping, count(*) AS n_orders, sum(n_items)::BIGINT AS n_items FROM o LEFT JOIN a USING (order_id) LEFT JOIN cl USING (order_id) GROUP BY ALL""",
    "merchandise_components": _FAMILY + """
, link AS (SELECT order_id, 'r' || row_no AS x, 'i' || item_index AS y FROM pairs UNION ALL SELECT order_id, 'i' || item_index, 'p' || promotion FROM fi WHERE promotion IS NOT NULL),
both_ways AS (SELECT order_id, x, y FROM link UNION SELECT order_id, y, x FROM link),
reach AS (
  WITH RECURSIVE walk AS (SELECT DISTINCT order_id, x, x AS y FROM both_ways UNION SELECT w.order_id, w.x, b.y FROM walk w JOIN both_ways b ON b.order_id = w.order_id AND b.x = w.y)
  SELECT order_id, x, min(y) AS comp FROM walk GROUP BY ALL),
mem AS (SELECT order_id, comp, x, price_c AS rp, NULL::BIGINT AS ip, NULL AS promotion, NULL::BIGINT AS group_c FROM reach JOIN (SELECT order_id, 'r' || row_no AS x, price_c FROM fr) USING (order_id, x)
        UNION ALL SELECT order_id, comp, x, NULL, subtotal_c, promotion, group_c FROM reach JOIN (SELECT order_id, 'i' || item_index AS x, subtotal_c, promotion, group_c FROM fi) USING (order_id, x)),
cmp AS (SELECT order_id, comp, count(rp) AS n_rows, count(ip) AS n_items, sum(rp) AS sv, CASE WHEN count(*) FILTER (promotion IS NOT NULL AND group_c IS NULL) = 0 THEN coalesce(sum(ip) FILTER (promotion IS NULL), 0) + coalesce(max(group_c), 0) END AS iv, count(promotion) AS n_p FROM mem GROUP BY ALL),
free_r AS (SELECT order_id, count(*) AS k, sum(price_c) AS v FROM fr WHERE (order_id, 'r' || row_no) NOT IN (SELECT (order_id, x) FROM reach) GROUP BY ALL),
free_i AS (SELECT order_id, count(*) AS k, sum(subtotal_c) AS v FROM fi WHERE (order_id, 'i' || item_index) NOT IN (SELECT (order_id, x) FROM reach) GROUP BY ALL),
every AS (SELECT CASE WHEN n_p > 0 THEN 'PROMOTION_COMPONENT' WHEN n_rows = 1 AND n_items = 1 THEN 'ITEM' ELSE 'FAMILY' END AS scope, n_rows, n_items, CASE WHEN n_rows > 0 AND n_items > 0 THEN sv - iv END AS diff FROM cmp
          UNION ALL SELECT CASE WHEN r.k = 1 AND i.k = 1 THEN 'UNRESOLVED_ORDER_RESIDUAL' ELSE 'COVERAGE_CONTROL' END, coalesce(r.k, 0), coalesce(i.k, 0), CASE WHEN r.k = 1 AND i.k = 1 THEN r.v - i.v END FROM free_r r FULL JOIN free_i i USING (order_id))
SELECT scope, coalesce(abs(diff) <= 2, false) AS reconciled, count(*) AS n_components, sum(n_rows)::BIGINT AS n_rows, sum(n_items)::BIGINT AS n_items, sum(diff) / 100.0 AS difference FROM every GROUP BY ALL""",
}

SQL = {name: CANONICAL + body for name, body in BODIES.items()}
