"""Order analysis: roll-ups at order grain, reconciliation, metrics, trends.

Every side is aggregated to its key before it is joined, so order amounts never fan out to items.
Missing is never zero: a sum over rows of which one is missing is missing.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = "0.02"
STATES = ("RECONCILED", "MISMATCH", "INSUFFICIENT_DATA", "MISSING_STATEMENT")
NOT_FEES = ("Product Price", "Refund Amount")


def sum_or_missing(value: Column) -> Column:
    """The sum, or NULL if any row has none."""
    return F.when(F.count_if(value.isNull()) > 0, None).otherwise(F.sum(value))


def component_facts(components: DataFrame) -> DataFrame:
    """One row per order: count and charges, credits, refund and other totals of its components."""
    amount, fee = F.col("amount"), ~F.col("name").isin(*NOT_FEES)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("decimal(18,2)")
    return components.groupBy("order_id").agg(
        F.count("*").alias("n_components"),
        zero(F.sum(F.when(fee & (amount < 0), amount))).alias("charges"),
        zero(F.sum(F.when(fee & (amount > 0), amount))).alias("credits"),
        zero(F.sum(F.when(F.col("name") == "Refund Amount", amount))).alias("refund"),
        zero(F.sum(F.when(F.col("name") == "Product Price", amount))).alias("sales"),
        zero(F.sum(F.when(F.col("name") != "Product Price", amount))).alias("non_product"),
    )


def ledger_facts(ledger: DataFrame) -> DataFrame:
    """The columns of `component_facts` beside each order's array of components; nothing is shuffled."""
    fee = lambda x: ~x["name"].isin(*NOT_FEES)
    total = lambda keep: F.aggregate(F.filter("components", keep), F.lit(0).cast("decimal(18,2)"), lambda acc, x: (acc + x["amount"]).cast("decimal(18,2)"))
    return ledger.withColumns(
        {
            "n_components": F.size("components").cast("long"),
            "charges": total(lambda x: fee(x) & (x["amount"] < 0)),
            "credits": total(lambda x: fee(x) & (x["amount"] > 0)),
            "refund": total(lambda x: x["name"] == "Refund Amount"),
            "sales": total(lambda x: x["name"] == "Product Price"),
            "non_product": total(lambda x: x["name"] != "Product Price"),
        }
    )


def reconcile(orders: DataFrame, components: DataFrame, statements: DataFrame, adjustments: DataFrame | None = None) -> DataFrame:
    """Each order with expected and released amounts, their difference and its state.

    Adjustments are shown beside, never netted into the difference.
    """
    return _states(orders.join(component_facts(components), "order_id", "left").join(statements, "order_id", "left"), adjustments)


def reconcile_ledger(orders: DataFrame, ledger: DataFrame, adjustments: DataFrame | None = None) -> DataFrame:
    """`reconcile` where one row per order holds its components and what was released."""
    facts = ledger_facts(ledger).withColumn("payout", F.when(F.col("released").isNotNull(), F.col("payout")))
    columns = ["n_components", "charges", "credits", "refund", "sales", "non_product", "released", "payout"]
    return _states(orders.join(facts.select("order_id", *columns), "order_id", "left"), adjustments)


def _states(rows: DataFrame, adjustments: DataFrame | None) -> DataFrame:
    if adjustments is not None:
        per_order = adjustments.groupBy("order_id").agg(F.sum("amount").cast("decimal(18,2)").alias("adjusted"), F.count("*").alias("n_adjustments"))
        rows = rows.join(per_order, "order_id", "left").withColumns({"adjusted": F.coalesce("adjusted", F.lit(0).cast("decimal(18,2)")), "n_adjustments": F.coalesce("n_adjustments", F.lit(0))})
    expected = (F.col("sales") + F.col("non_product")).cast("decimal(18,2)")
    rows = rows.withColumn("expected", expected).withColumn("difference", (F.col("released") - expected).cast("decimal(18,2)"))
    state = (
        F.when(F.col("n_components").isNull(), "INSUFFICIENT_DATA")
        .when(F.col("released").isNull(), "MISSING_STATEMENT")
        .when(F.abs("difference") <= F.lit(TOLERANCE).cast("decimal(18,2)"), "RECONCILED")
        .otherwise("MISMATCH")
    )
    return rows.withColumn("state", state)


@dataclass(frozen=True)
class Filters:
    """What an analysis is restricted to; an empty filter restricts nothing."""

    statuses: tuple[str, ...] = ()
    order_id_part: str = ""
    states: tuple[str, ...] = ()
    created: tuple[date | None, date | None] = (None, None)
    payout: tuple[date | None, date | None] = (None, None)
    skus: tuple[str, ...] = ()
    fees: tuple[str, ...] = ()
    has_refund: bool | None = None
    has_adjustment: bool | None = None

    def apply(self, rows: DataFrame, items: DataFrame, components: DataFrame) -> DataFrame:
        """The orders that pass; products and fees by semi-joins, so no order is repeated."""
        if self.statuses:
            rows = rows.where(F.col("status").isin(*self.statuses))
        if self.order_id_part:
            rows = rows.where(F.lower("order_id").contains(self.order_id_part.lower()))
        if self.states:
            rows = rows.where(F.col("state").isin(*self.states))
        for column, (low, high) in (("created", self.created), ("payout", self.payout)):
            if low:
                rows = rows.where(F.col(column) >= F.lit(low))
            if high:
                rows = rows.where(F.col(column) <= F.lit(high))
        if self.skus:
            rows = rows.join(items.where(F.col("sku").isin(*self.skus)), "order_id", "left_semi")
        if self.fees:
            rows = rows.where("state != 'MISSING_STATEMENT'").join(components.where(F.col("name").isin(*self.fees)), "order_id", "left_semi")
        if self.has_refund is not None:
            rows = rows.where((F.coalesce("refund", F.lit(0)) != 0) == F.lit(self.has_refund))
        if self.has_adjustment is not None:
            rows = rows.where((F.col("n_adjustments") > 0) == F.lit(self.has_adjustment))
        return rows


def metrics(rows: DataFrame) -> DataFrame:
    """One row of report metrics over reconciled orders."""
    settled = F.col("released").isNotNull()
    return rows.agg(
        F.count("*").alias("n_orders"),
        F.count_if(settled).alias("n_settled"),
        sum_or_missing(F.col("expected")).alias("expected"),
        F.sum("expected").alias("expected_known"),
        F.sum("released").alias("released"),
        F.abs(F.sum("refund")).alias("refunds"),
        F.when(F.count_if(settled) > 0, F.sum(F.when(settled, F.col("difference")))).alias("difference"),
    ).withColumn("coverage", F.when(F.col("n_orders") > 0, F.col("n_settled") / F.col("n_orders")))


def state_counts(rows: DataFrame) -> DataFrame:
    """Orders of every state, those without any included, and their share."""
    counts = rows.agg(*(F.count_if(F.col("state") == s).alias(s) for s in STATES)).unpivot([], list(STATES), "state", "n_orders")
    return counts.withColumn("share", F.try_divide(F.col("n_orders") * 100.0, F.sum("n_orders").over(Window.partitionBy())))


def waterfall(rows: DataFrame) -> DataFrame:
    """The steps from sales to what is expected."""
    total = rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("sales", "charges", "credits", "refund", "expected")))
    total = total.withColumn("other", F.col("expected") - F.col("sales") - F.col("charges") - F.col("credits") - F.col("refund"))
    steps = ["sales", "charges", "credits", "refund", "other", "expected"]
    return total.select(*(F.col(c).cast("decimal(38,2)").alias(c) for c in steps)).unpivot([], steps, "step", "amount")


def bucket(day: Column, granularity: str, start: Column) -> Column:
    """The first day of a trend's bucket: weeks are counted from the start, months begin on it at the earliest."""
    if granularity == "weekly":
        return F.date_add(start, (F.floor(F.datediff(day, start) / 7) * 7).cast("int"))
    return F.greatest(F.trunc(day, "month").cast("date"), start) if granularity == "monthly" else day


def default_granularity(start: Column, end: Column) -> Column:
    days = F.datediff(end, start)
    return F.when(days > 365, "monthly").when(days > 90, "weekly").otherwise("daily")


def trend(rows: DataFrame, granularity: str, start: date) -> DataFrame:
    """Sales, orders and charges of each bucket from the start on."""
    day = bucket(F.col("created"), granularity, F.lit(start))
    kept = rows.where(F.col("created") >= F.lit(start))
    return kept.groupBy("market", day.alias("day")).agg(F.count("*").alias("n_orders"), F.sum("sales").alias("sales"), F.sum("charges").alias("charges"))
