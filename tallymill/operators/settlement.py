"""Settlement evidence of orders: closure, reporting status, comparison and the waterfall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
TOLERANCE = "0.02"


def _near(difference: Column, tolerance: str = TOLERANCE) -> Column:
    return F.abs(difference) <= F.lit(tolerance).cast(MONEY)


def _key(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def payment_status(transferred_on: Column, income_type: Column) -> Column:
    """Released with a transfer date, Pending for an estimate, else N/A."""
    return F.when(transferred_on.isNotNull(), "Released").when(_key(income_type) == "estimated", "Pending").otherwise("N/A")


def closure(orders: DataFrame) -> DataFrame:
    """Orders with closure and its evidence, from payment evidence only: an order's status never closes it.

    orders: payment_status, released_on (the statement's payout) and transferred_on, among others.
    """
    paid = _key(F.col("payment_status"))
    evidence = (
        F.when(F.col("released_on").isNotNull() & (paid == "released"), "STATEMENT_ORIGINAL_PAYOUT")
        .when(F.col("transferred_on").isNotNull() & (paid != "pending"), "INVOICE_FUND_TRANSFER")
        .when((paid == "pending") & F.col("released_on").isNull() & F.col("transferred_on").isNull(), "EXPLICIT_PENDING")
    )
    state = F.when(evidence == "EXPLICIT_PENDING", "OPEN").when(evidence.isNotNull(), "CLOSED").otherwise("UNKNOWN")
    return orders.withColumns({"closure": state, "evidence": evidence})


def transition(settlement: Column, signal: Column) -> Column:
    """What a settlement changed, by the payment signal of the invoice."""
    before = F.when(_key(signal) == "pending", "Pending → Settled").when(_key(signal) == "released", "Already Released → Settled")
    return F.when(settlement == "Settled", before)


def order_compare(released: Column, final_amount: Column, income: Column, income_type: Column, found: Column | None = None) -> Column:
    """(source, expected, difference, status) of what was released against the invoice.

    The final amount comes first, then the order income; an estimate is never matched or different.
    """
    found = F.lit(True) if found is None else found
    source = F.when(final_amount.isNotNull(), "Final Amount").when(income.isNotNull(), "Order Income")
    expected = F.coalesce(final_amount, income)
    difference = (released - expected).cast(MONEY)
    estimated = (source == "Order Income") & (_key(income_type) == "estimated")
    status = F.when(~found, "UNMATCHED_ORDER").when(source.isNull(), "MISSING_COMPARISON_EVIDENCE").when(estimated, "ESTIMATED_ONLY").when(_near(difference), "MATCHED").otherwise("DIFFERENT")
    known = found & source.isNotNull()
    return F.struct(F.when(known, source).alias("source"), F.when(known, expected).alias("expected"), F.when(known, difference).alias("difference"), status.alias("status"))


def evidence(income: DataFrame) -> DataFrame:
    """One row per order of the statement's income rows (order_id, view_by, payout, released, refund).

    A row of the order view proves a settlement if it has a payout date and an amount; a broken row or
    rows that differ need a review; rows of the SKU view prove nothing.
    """
    is_order = F.col("view_by") == "Order"
    whole = F.col("payout").isNotNull() & F.col("released").isNotNull()
    broken = ~F.col("view_by").isin("Order", "Sku") | (is_order & ~whole)
    facts = F.struct("payout", "released", "refund")
    rows = income.groupBy("order_id").agg(F.count_if(broken).alias("n_broken"), F.count_if(is_order & whole).alias("n_whole"), F.size(F.collect_set(F.when(is_order & whole, facts))).alias("n_facts"), F.max(F.when(is_order & whole, facts)).alias("fact"))
    status = F.when((F.col("n_broken") > 0) | (F.col("n_facts") > 1), "Needs Review").when(F.col("n_whole") == 0, "No Settlement Evidence").otherwise("Settled")
    return rows.select("order_id", status.alias("settlement"), (F.col("n_whole") > 0).alias("has_order_row"), F.when(status == "Settled", F.col("fact")).alias("fact"))


def reporting(orders: DataFrame, income: DataFrame) -> DataFrame:
    """Each order with its settlement decision; nothing is changed on either side.

    orders: order_id, final_amount, order_income, income_type, payment_status, refund.
    """
    rows = orders.join(evidence(income), "order_id", "left").withColumn("settlement", F.coalesce("settlement", F.lit("No Settlement Evidence")))
    settled = F.col("settlement") == "Settled"
    theirs, ours = F.col("fact.refund"), F.coalesce("refund", F.lit(0).cast(MONEY))
    refund = F.when(~settled, "Unavailable").when(theirs.isNull(), "Needs Review").when((ours == 0) & (theirs == 0), "No Refund").when(_near(ours - theirs), "Matched").otherwise("Mismatch")
    ready = F.when(F.col("settlement") == "No Settlement Evidence", "No Settlement Evidence").when(settled & refund.isin("Matched", "No Refund"), "Ready to Invoice").otherwise("Needs Review")
    compared = order_compare(F.col("fact.released"), F.col("final_amount"), F.col("order_income"), F.col("income_type"))
    return rows.withColumns(
        {
            "refund_validation": refund,
            "ready": ready,
            "compared": F.when(settled, compared),
            "transition": transition(F.col("settlement"), F.col("payment_status")),
            "effective_payment": F.when(settled, "Settled").otherwise(F.col("payment_status")),
        }
    )


def reporting_summary(rows: DataFrame, income: DataFrame, orders: DataFrame) -> DataFrame:
    """One row of counters over `reporting`'s rows and the statement's orders."""
    of = lambda column, value: F.count_if(F.col(column) == value)
    statement_ids = income.where("view_by = 'Order' AND payout IS NOT NULL AND released IS NOT NULL").select("order_id").distinct()
    ids = statement_ids.join(orders.select("order_id").distinct().withColumn("ours", F.lit(1)), "order_id", "left").agg(F.count("*").alias("n_statement_orders"), F.count("ours").alias("n_covered"))
    counted = rows.agg(
        F.count("*").alias("n_orders"),
        of("settlement", "No Settlement Evidence").alias("n_no_evidence"),
        of("transition", "Pending → Settled").alias("n_pending_to_released"),
        of("transition", "Already Released → Settled").alias("n_already_released"),
        *(of("compared.status", s.upper()).alias(f"n_{s}") for s in ("different", "matched", "estimated_only", "missing_comparison_evidence")),
    )
    return counted.join(F.broadcast(ids)).withColumn("n_unmatched", F.col("n_statement_orders") - F.col("n_covered"))  # one row each


STEPS = ("merchandise", "refund", "shipping", "voucher_rebate", "fees")


def adjustment_proof(orders: DataFrame, events: DataFrame) -> DataFrame:
    """Orders with `proof`: how linked adjustments explain final amount less income, or NULL.

    orders: order_id, final_amount, order_income, statement_hash; events: order_id, fingerprint,
    amount, statement_hash. CURRENT: events of the same statement, within the tolerance.
    CROSS_PERIOD: events of other statements, exactly, each fingerprint once.
    """
    own = orders.select("order_id", F.col("statement_hash").alias("own_hash"))
    linked = events.join(own, "order_id").withColumn("current", F.col("statement_hash").eqNullSafe(F.col("own_hash")))
    cross = ~F.col("current")
    sums = linked.groupBy("order_id").agg(
        F.sum(F.when(F.col("current"), F.col("amount"))).cast(MONEY).alias("current_total"),
        F.sum(F.when(cross, F.col("amount"))).cast(MONEY).alias("cross_total"),
        F.count_if(cross).alias("n_cross"),
        F.count_if(cross & (F.col("fingerprint").isNull() | F.col("amount").isNull() | F.col("statement_hash").isNull())).alias("n_incomplete"),
        F.countDistinct(F.when(cross, F.col("fingerprint"))).alias("n_fingerprints"),
    )
    delta = (F.col("final_amount") - F.col("order_income")).cast(MONEY)
    whole = (F.col("n_cross") > 0) & (F.col("n_incomplete") == 0) & (F.col("n_fingerprints") == F.col("n_cross"))
    proof = F.when(_near(F.col("current_total") - delta), "CURRENT").when(whole & (F.col("cross_total") == delta), "CROSS_PERIOD")
    return orders.join(sums, "order_id", "left").withColumn("proof", proof)


def waterfall(rows: DataFrame) -> DataFrame:
    """Orders with statement total, raw difference, explained delta, residual and basis (EXACT, EXPLAINED or NONE).

    rows: order_id, income_type, layout, order_income, final_amount, proof, and for each of STEPS the
    statement's s_<step> (NULL where the component is missing) and the invoice's i_<step>. A statement
    refund that the invoice couldn't know yet (an estimate of a normal order without one) explains itself.
    """
    zero = F.lit(0).cast(MONEY)
    state = _key(F.col("income_type"))
    usable = state.isin("final", "estimated") & F.col("order_income").isNotNull()
    for s in STEPS:
        usable = usable & F.col(f"s_{s}").isNotNull()
    usable = usable & (F.col("final_amount").isNull() | (F.col("final_amount") == F.col("order_income")) | F.col("proof").isNotNull())
    late = (state == "estimated") & (F.col("layout") == "NORMAL_ORDER") & F.col("i_refund").isNull() & (F.col("s_refund") != 0)
    total, explained, missing = zero, zero, F.lit(False)
    for s in STEPS:
        theirs, ours = F.col(f"s_{s}"), F.col(f"i_{s}")
        allowed = late if s == "refund" else F.lit(False)
        total = (total + theirs).cast(MONEY)
        explained = (explained + F.when(ours.isNotNull(), theirs - ours).when(allowed, theirs).otherwise(zero)).cast(MONEY)
        missing = missing | (ours.isNull() & (theirs != 0) & ~allowed)
    raw = (total - F.col("order_income")).cast(MONEY)
    residual = (raw - explained).cast(MONEY)
    basis = F.when(~usable, "NONE").when(_near(raw), "EXACT").when(~missing & _near(residual), "EXPLAINED").otherwise("NONE")
    return rows.withColumns({"statement_total": F.when(usable, total), "raw_difference": F.when(usable, raw), "explained_delta": F.when(usable, explained), "residual": F.when(usable, residual), "basis": basis, "late_refund": F.coalesce(usable & late, F.lit(False))})
