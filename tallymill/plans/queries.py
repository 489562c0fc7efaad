"""The registered queries: operators applied to the canonical relations.

Money leaves as double, so that any engine can compare it.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymill.functions import casts, text
from tallymill.operators import allocation, analysis, changes, guards, matching, products, settlement
from tallymill.plans import relations
from tallymill.sources import canonical as c
from tallymill.workers import find_library

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
START = date(1995, 3, 10)


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def as_double(spark: SparkSession, sf_dir: str) -> DataFrame:
        find_library(spark)
        out = f(spark, sf_dir)
        return out.select(*(F.col(f"`{n}`").cast("double").alias(n) if t.startswith("decimal") else F.col(f"`{n}`") for n, t in out.dtypes))

    as_double.__name__, as_double.__doc__ = f.__name__, f.__doc__
    QUERIES[f.__name__] = as_double
    return as_double


def _reconciled(spark: SparkSession, d: str) -> DataFrame:
    return analysis.reconcile_ledger(c.orders(spark, d), c.ledger(spark, d), c.adjustments(spark, d))


@query
def order_settlement_report(spark: SparkSession, d: str) -> DataFrame:
    """Orders and amounts by market, month of creation and state."""
    rows = _reconciled(spark, d)
    return rows.groupBy("market", F.trunc("created", "month").cast("date").alias("month"), "state").agg(F.count("*").alias("n_orders"), F.sum("expected").alias("expected"), F.sum("released").alias("released"), F.sum("difference").alias("difference"))


@query
def order_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    return _reconciled(spark, d).select("order_id", "market", "status", "expected", "released", "difference", "adjusted", "n_adjustments", "state")


@query
def order_facts(spark: SparkSession, d: str) -> DataFrame:
    return analysis.component_facts(c.components(spark, d))


@query
def component_ledger(spark: SparkSession, d: str) -> DataFrame:
    return c.components(spark, d)


@query
def component_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = c.components(spark, d).join(c.orders(spark, d).select("order_id", "market"), "order_id")
    return rows.groupBy("market", "name", F.signum("amount").cast("int").alias("sign")).agg(F.sum("amount").alias("amount"), F.count("*").alias("n_rows"))


@query
def report_metrics(spark: SparkSession, d: str) -> DataFrame:
    return analysis.metrics(_reconciled(spark, d))


@query
def state_counts(spark: SparkSession, d: str) -> DataFrame:
    return analysis.state_counts(_reconciled(spark, d))


@query
def settlement_waterfall(spark: SparkSession, d: str) -> DataFrame:
    return analysis.waterfall(_reconciled(spark, d))


def _trend(granularity: str) -> None:
    def trend(spark: SparkSession, d: str) -> DataFrame:
        return analysis.trend(_reconciled(spark, d), granularity, START)

    trend.__name__ = f"trend_{granularity}"
    query(trend)


for _granularity in ("daily", "weekly", "monthly"):
    _trend(_granularity)


@query
def analysis_filters(spark: SparkSession, d: str) -> DataFrame:
    """Completed orders of a period with refunds and fees."""
    chosen = analysis.Filters(statuses=("Completed", "To Ship"), created=(date(1994, 1, 1), date(1997, 6, 30)), states=("RECONCILED", "MISMATCH"), fees=("Transaction Fee",), has_refund=True)
    return chosen.apply(_reconciled(spark, d), c.items(spark, d), c.components(spark, d)).select("order_id", "market", "created", "refund", "state")


@query
def eligible_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders that are neither open nor cancelled, with at least one item."""
    status = F.lower(F.regexp_replace(F.trim("status"), r"\s+", " "))
    return c.orders(spark, d).where(~status.isin("to ship", "cancelled")).join(c.items(spark, d), "order_id", "left_semi").groupBy("market", "status").agg(F.count("*").alias("n_orders"), F.sum("final_amount").alias("final_amount"))


@query
def product_summary(spark: SparkSession, d: str) -> DataFrame:
    return products.product_summary(c.items(spark, d), ["sku"])


@query
def top_products(spark: SparkSession, d: str) -> DataFrame:
    """The ten products with the largest sales, and their share."""
    top = products.ranked(products.product_summary(c.items(spark, d), ["sku"]), "amount", "sku", 10)
    return top.select("sku", "quantity", "amount", F.round("share", 6).alias("share"))


@query
def master_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Items looked up by SKU, then by product and variation of a SKU that lost its digits."""
    m = c.master(spark, d)
    rows = c.items(spark, d).join(m.select("sku", "parent", "product", "variation"), "sku").withColumn("sku", F.when(F.col("sku").cast("long") % 3 == 0, F.concat(F.lit("X-"), "sku")).otherwise(F.col("sku")))
    found = products.lookup(rows, m, [("SKU", ["sku"]), ("NAME_VARIATION", ["product", "variation"]), ("PARENT", ["parent"])], "sku")
    return found.groupBy("tier", "outcome").agg(F.count("*").alias("n_items"), F.sum("master_price").alias("master_price"), F.sum("subtotal").alias("subtotal"))


def _cents(column: str) -> Column:
    return (F.col(column) * 100).cast("long")


@query
def promotion_allocation(spark: SparkSession, d: str) -> DataFrame:
    """Each promotion's total, less three cents in a hundred, over its items by largest remainder."""
    group = ["order_id", "flag"]
    rows = c.items(spark, d).withColumn("w", _cents("subtotal")).withColumn("total", F.floor(F.sum("w").over(Window.partitionBy(group)) * 97 / 100).cast("long"))
    return allocation.largest_remainder(rows, group, F.col("total"), F.col("w"), ["sku", "item_index"]).select("order_id", "flag", "item_index", "sku", "total", "allocated")


@query
def promotion_pricing(spark: SparkSession, d: str) -> DataFrame:
    """Each order's discount over its items by quantity; the last item takes the rest."""
    rows = c.items(spark, d).withColumn("total", F.sum(_cents("original") - _cents("subtotal")).over(Window.partitionBy("order_id")))
    return allocation.last_takes_rest(rows, ["order_id"], F.col("total"), F.col("quantity"), ["item_index"]).select("order_id", "item_index", "total", "allocated")


@query
def unit_allocation(spark: SparkSession, d: str) -> DataFrame:
    """Each order's fees over its units in equal cents, the earliest units first."""
    rows = c.items(spark, d).withColumn("total", F.sum(_cents("fee")).over(Window.partitionBy("order_id")))
    return allocation.earliest_units(rows, ["order_id"], F.col("total"), F.col("quantity"), ["item_index"]).select("order_id", "item_index", "total", "allocated")


def _incoming(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The orders as they were known up to a day, and an export of all since an earlier one, some of them changed.

    The two spans overlap, so every order is in one of them at least.
    """
    every, key = c.orders(spark, d), F.col("order_id").cast("long")
    changed = every.withColumn("status", F.when(key % 11 == 0, F.lit("Returned")).otherwise(F.col("status")))
    return every.where(F.col("created") < F.lit(date(1997, 1, 1))), changed.where(F.col("created") >= F.lit(date(1994, 1, 1)))


@query
def snapshot_classes(spark: SparkSession, d: str) -> DataFrame:
    return changes.classify(*_incoming(spark, d), ["market", "order_id"])


@query
def snapshot_merge(spark: SparkSession, d: str) -> DataFrame:
    return changes.merge(*_incoming(spark, d), ["market", "order_id"])


@query
def snapshot_missing_only(spark: SparkSession, d: str) -> DataFrame:
    return changes.missing_only(*_incoming(spark, d), ["market", "order_id"]).select("market", "order_id", "status")


@query
def fact_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Adjustments of one order and kind: available, equal rows, or conflicting."""
    rows = c.adjustments(spark, d).withColumn("fact", F.concat_ws("/", "order_id", "kind"))
    return changes.resolve_facts(rows, "fact", ["day", "amount"])


@query
def duplicate_rows(spark: SparkSession, d: str) -> DataFrame:
    """Line numbers that an order has more than once."""
    rows = c.table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("order_id"), "l_linenumber")
    return guards.duplicates(rows, ["order_id", "l_linenumber"])


@query
def orphan_adjustments(spark: SparkSession, d: str) -> DataFrame:
    return guards.orphans(c.adjustments(spark, d), c.orders(spark, d), ["order_id"]).groupBy("kind").agg(F.count("*").alias("n_events"), F.sum("amount").alias("amount"))


@query
def orders_without_items(spark: SparkSession, d: str) -> DataFrame:
    return guards.orphans(c.orders(spark, d), c.items(spark, d), ["order_id"]).select("order_id", "market", "status")


@query
def first_adjustments(spark: SparkSession, d: str) -> DataFrame:
    rows = changes.first_of_each(c.adjustments(spark, d), ["order_id", "kind"], ["day", "event_id"])
    return rows.where("NOT is_duplicate").select("order_id", "kind", "event_id", "day", "amount")


@query
def event_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Count, nearest-rank median and 95th percentile, and sum per kind."""
    rows = c.adjustments(spark, d)
    amounts = rows.groupBy("kind", "amount").agg(F.count("*").alias("n_equal"), F.sum("amount").alias("total"))  # no window holds a kind's raw rows
    kind = Window.partitionBy("kind")
    upto = F.sum("n_equal").over(kind.orderBy("amount").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = amounts.select("*", upto.alias("upto"), F.sum("n_equal").over(kind).alias("n"))
    rank = lambda percent: F.ceil(F.col("n") * percent / 100)
    at = lambda percent: F.max(F.when((F.col("upto") >= rank(percent)) & (F.col("upto") - F.col("n_equal") < rank(percent)), F.col("amount")))
    return ranked.groupBy("kind").agg(F.sum("n_equal").alias("n_events"), at(50).alias("median"), at(95).alias("p95"), F.sum("total").alias("amount"))


@query
def billing_periods(spark: SparkSession, d: str) -> DataFrame:
    """Weeks of payout: orders, amounts, whether one market only."""
    rows = c.statements(spark, d).join(c.orders(spark, d), "order_id")
    return rows.groupBy(F.date_trunc("week", "payout").cast("date").alias("period")).agg(F.count("*").alias("n_orders"), F.countDistinct("market").alias("n_markets"), F.sum("released").alias("released"), F.min("payout").alias("first_day"), F.max("payout").alias("last_day"))


@query
def billing_controls(spark: SparkSession, d: str) -> DataFrame:
    """Per market: quantities and amounts of the billed items against the components they come from."""
    scope = c.orders(spark, d).where("status != 'Cancelled'").join(c.statements(spark, d), "order_id", "left_semi").select("order_id", "market")
    item_side = c.items(spark, d).join(scope, "order_id").groupBy("market").agg(F.countDistinct("order_id").alias("n_orders"), F.countDistinct("sku").alias("n_products"), F.sum("quantity").alias("quantity"), F.sum("original").alias("original"), F.sum("subtotal").alias("amount"))
    native = c.components(spark, d).where("name IN ('Product Price', 'Discount')").join(scope, "order_id").groupBy("market").agg(F.sum("amount").alias("native_amount"))
    return item_side.join(native, "market").withColumn("discount", F.col("original") - F.col("amount")).withColumn("balanced", F.col("amount") == F.col("native_amount"))


@query
def fee_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Fees of settled orders by state and name."""
    settled = _reconciled(spark, d).where("released IS NOT NULL").select("order_id", "state")
    return c.components(spark, d).where("name NOT IN ('Product Price', 'Refund Amount')").join(settled, "order_id").groupBy("state", "name").agg(F.sum("amount").alias("amount"), F.count("*").alias("n_rows"))


@query
def pricing_anomalies(spark: SparkSession, d: str) -> DataFrame:
    """Items whose unit price is below the master's: the discount is negative and kept."""
    rows = c.items(spark, d).join(c.master(spark, d), "sku").withColumn("discount", (F.col("quantity") * F.col("unit_price") - F.col("subtotal")).cast("decimal(18,2)"))
    return rows.groupBy("parent").agg(F.count_if(F.col("discount") < F.lit("-0.02").cast("decimal(18,2)")).alias("n_anomalies"), F.count("*").alias("n_items"), F.sum("discount").alias("discount"))


@query
def row_eligibility(spark: SparkSession, d: str) -> DataFrame:
    """Items by the reasons that keep them from billing, in a fixed order."""
    rows = c.items(spark, d).join(c.master(spark, d), "sku", "left")
    reasons = F.array_compact(F.array(F.when(F.col("product").isNull(), "NO_MASTER"), F.when(F.col("quantity") > 48, "QUANTITY"), F.when(F.col("flag") == "R", "RETURNED"), F.when(F.col("subtotal") < F.lit(1000).cast("decimal(18,2)"), "SMALL_AMOUNT")))
    return rows.groupBy(F.array_join(reasons, ";").alias("reasons"), (F.size(reasons) == 0).alias("normal")).agg(F.count("*").alias("n_items"), F.sum("subtotal").alias("amount"))


@query
def exception_queue(spark: SparkSession, d: str) -> DataFrame:
    """One work item per order that is not reconciled or has a late adjustment."""
    rows = _reconciled(spark, d)
    by_state = rows.where("state != 'RECONCILED'").select("order_id", F.lit(0).alias("position"), F.col("state").alias("reason"), (F.col("state") == "MISMATCH").alias("blocking"), F.lit("review").alias("action"))
    late = rows.where("n_adjustments > 0 AND abs(adjusted) > 100").select("order_id", F.lit(1).alias("position"), F.lit("LARGE_ADJUSTMENT").alias("reason"), F.lit(False).alias("blocking"), F.lit("confirm").alias("action"))
    return changes.exception_queue(by_state.unionByName(late), "order_id")


@query
def text_casts(spark: SparkSession, d: str) -> DataFrame:
    """Amounts written as text, in several ways, and read again."""
    rows = c.orders(spark, d).select("order_id", F.col("final_amount").cast("string").alias("t"))
    return rows.select("order_id", casts.lenient_money(F.concat(F.lit("RM "), "t")).alias("lenient"), casts.lenient_quantity(F.concat(F.lit("x"), "t")).alias("quantity"), casts.strict_price(F.concat(F.lit("RM"), "t")).alias("strict"), casts.strict_price(F.concat("t", F.lit(" each"))).alias("not_strict"), casts.statement_money(F.concat(F.lit("("), "t", F.lit(")"))).alias("statement"))


@query
def barcodes(spark: SparkSession, d: str) -> DataFrame:
    """Products with a 13-digit code made from their key: which codes check out."""
    code = F.lpad(F.col("sku"), 13, "0")
    return c.master(spark, d).select("sku", code.alias("code"), text.is_ean13(code).alias("is_ean13"), text.bundle(F.concat("sku", F.lit("-"), (F.length("product") % 10).cast("string")), F.lit(2))["multiplier"].alias("suffix"), text.adjustment_type(F.col("variation")).alias("kind"), text.short_label(F.concat_ws(" ", "product", "variation", "product"), 24).alias("label"))


@query
def period_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = c.statements(spark, d).groupBy(F.trunc("payout", "month").cast("date").alias("month")).agg(F.min("payout").alias("first_day"), F.max("payout").alias("last_day"), F.count("*").alias("n_orders"))
    return rows.withColumn("label", text.period_label(F.col("month"), F.last_day("month"))).withColumn("granularity", analysis.default_granularity(F.col("month"), F.col("last_day")))


@query
def transaction_closure(spark: SparkSession, d: str) -> DataFrame:
    """Orders by payment status and by whether the evidence says that they are open or closed."""
    rows = settlement.closure(relations.invoices(spark, d))
    return rows.groupBy("payment_status", "closure", "evidence").agg(F.count("*").alias("n_orders"), F.sum("order_income").alias("order_income"))


@query
def fact_completeness(spark: SparkSession, d: str) -> DataFrame:
    """Orders against component facts: what either side lacks."""
    rows = c.orders(spark, d).select("order_id", F.lit(1).alias("o")).join(c.ledger(spark, d).select("order_id", F.lit(1).alias("f")), "order_id", "full_outer")
    kind = F.when(F.col("o").isNull(), "NO_ORDER").when(F.col("f").isNull(), "NO_FACT").otherwise("BOTH")
    return rows.groupBy(kind.alias("coverage")).agg(F.count("*").alias("n_orders"))


@query
def bundle_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Orders' item bundles against an older copy with changed and missing items."""
    new, key = c.items(spark, d), F.col("order_id").cast("long")
    old = new.where((key % 6 != 0) & ~((key % 6 == 1) & (F.col("item_index") == 0))).withColumn("item_index", F.when(key % 6 == 3, F.col("item_index") + 10).otherwise(F.col("item_index"))).withColumn("quantity", F.when(key % 6 == 2, F.col("quantity") + 1).otherwise(F.col("quantity")))
    verdicts = changes.classify_bundles(old, new, "order_id", ["item_index", "sku", "quantity", "subtotal"])
    return verdicts.groupBy("verdict").agg(F.count("*").alias("n_orders"), F.sum("n_rows").alias("n_rows"))


@query
def incremental_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts kept by revisions of a change feed: equal to those computed at once."""
    from tallymill.streaming import facts

    return facts.replayed(c.components(spark, d), c.adjustments(spark, d))


@query
def upsert_changes(spark: SparkSession, d: str) -> DataFrame:
    """What an upsert of the incoming snapshot inserts and updates."""
    current, incoming = _incoming(spark, d)
    return matching.upsert_changes(current, incoming, ["market", "order_id"]).select("market", "order_id", "status", "action")


@query
def statement_compare(spark: SparkSession, d: str) -> DataFrame:
    """Final order amounts against released ones, order by order."""
    return matching.statement_compare(c.orders(spark, d), c.statements(spark, d)).groupBy("outcome").agg(F.count("*").alias("n_orders"), F.sum("ours").alias("ours"), F.sum("theirs").alias("theirs"))


@query
def identity_matching(spark: SparkSession, d: str) -> DataFrame:
    """Statement rows per order and return flag, told apart by their amounts to ten units of money.

    The statement has the items' amounts, but for one row of every ninth order, which is far off.
    """
    both = c.items(spark, d).select("order_id", F.col("flag").alias("product_key"), "item_index", F.col("subtotal").alias("amount"))
    off = (F.col("order_id").cast("long") % 9 == 0) & (F.col("item_index") == 0)
    rows = both.select("order_id", "product_key", F.col("item_index").alias("row_no"), F.when(off, F.col("amount") + 1_000_000).otherwise(F.col("amount")).cast("decimal(18,2)").alias("amount"))
    return matching.resolve(rows, both, "10.00")


@query
def order_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Orders per market: with items, with components, with a statement, with all of them."""
    o = c.orders(spark, d).select("market", "order_id")
    mark = lambda rows, name: rows.select("order_id").distinct().withColumn(name, F.lit(1))
    rows = o.join(mark(c.items(spark, d), "i"), "order_id", "left").join(mark(c.components(spark, d), "p"), "order_id", "left").join(mark(c.statements(spark, d), "s"), "order_id", "left")
    return rows.groupBy("market").agg(F.count("*").alias("n_orders"), F.count("i").alias("with_items"), F.count("p").alias("with_components"), F.count("s").alias("with_statement"), F.count_if(F.col("i").isNotNull() & F.col("p").isNotNull() & F.col("s").isNotNull()).alias("with_all"))


@query
def invoice_totals_by_day(spark: SparkSession, d: str) -> DataFrame:
    """Running amounts of each market's orders by day."""
    per_day = c.orders(spark, d).groupBy("market", "created").agg(F.count("*").alias("n_orders"), F.sum("final_amount").alias("final_amount"))
    so_far = Window.partitionBy("market").orderBy("created")
    return per_day.select("*", F.sum("final_amount").over(so_far).alias("so_far"), F.row_number().over(so_far).cast("long").alias("day_no"))


@query
def adjustment_matches(spark: SparkSession, d: str) -> DataFrame:
    """Adjustments by kind and month, with and without an order."""
    known = c.orders(spark, d).select("order_id", F.lit(True).alias("known"))
    rows = c.adjustments(spark, d).join(known, "order_id", "left")
    return rows.groupBy("kind", F.trunc("day", "month").cast("date").alias("month"), F.coalesce("known", F.lit(False)).alias("has_order")).agg(F.count("*").alias("n_events"), F.sum("amount").alias("amount"), F.countDistinct("order_id").alias("n_orders"))
