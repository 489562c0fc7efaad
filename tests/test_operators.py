"""Rules that are easy to get wrong, on hand-made rows."""

import math

from datetime import date
from decimal import Decimal as D

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallymill.functions import casts, text
from tallymill.operators import allocation, analysis, changes, guards, invoice_checks, matching, products, reconciliation

ORDER = "market string, order_id string, status string, created date, final_amount decimal(18,2)"
COMPONENT = "order_id string, name string, amount decimal(18,2)"
STATEMENT = "order_id string, released decimal(18,2), payout date"


def reconciled(spark, components, statements, orders=("1",)):
    o = spark.createDataFrame([("MY", i, "Completed", date(2024, 1, 1), D("1.00")) for i in orders], ORDER)
    return {r["order_id"]: r for r in analysis.reconcile(o, spark.createDataFrame(components, COMPONENT), spark.createDataFrame(statements, STATEMENT)).collect()}


def test_tolerance_is_per_order_and_inclusive(spark):
    parts = [(i, "Product Price", D("100.00")) for i in "123"] + [("1", "Transaction Fee", D("-5.00"))]
    found = reconciled(spark, parts, [("1", D("95.02"), None), ("2", D("100.03"), None)], "1234")
    assert [found[i]["state"] for i in "1234"] == ["RECONCILED", "MISMATCH", "MISSING_STATEMENT", "INSUFFICIENT_DATA"]
    assert found["1"]["difference"] == D("0.02") and found["3"]["difference"] is None


def test_a_missing_amount_makes_the_sum_missing(spark):
    rows = spark.createDataFrame([(D("1.00"),), (None,)], "x decimal(18,2)")
    assert rows.agg(analysis.sum_or_missing(F.col("x")).alias("s")).first()["s"] is None


def test_metrics_of_an_empty_cohort(spark):
    rows = analysis.reconcile(spark.createDataFrame([], ORDER), spark.createDataFrame([], COMPONENT), spark.createDataFrame([], STATEMENT))
    one = analysis.metrics(rows).first()
    assert one["n_orders"] == 0 and one["difference"] is None and one["coverage"] is None


def test_weeks_are_counted_from_the_start_and_months_begin_there(spark):
    rows = spark.createDataFrame([(date(2024, 3, 20),), (date(2024, 4, 2),)], "d date")
    start = F.lit(date(2024, 3, 10))
    got = rows.select(analysis.bucket(F.col("d"), "weekly", start).alias("w"), analysis.bucket(F.col("d"), "monthly", start).alias("m")).collect()
    assert [tuple(r) for r in got] == [(date(2024, 3, 17), date(2024, 3, 10)), (date(2024, 3, 31), date(2024, 4, 1))]


@pytest.mark.parametrize("total", [100, -100, 1, 0, 101])
def test_largest_remainder_keeps_the_total(spark, total):
    rows = spark.createDataFrame([("g", i, w) for i, w in enumerate((1, 1, 1, 4))], "g string, i int, w long")
    got = allocation.largest_remainder(rows, ["g"], F.lit(total).cast("long"), F.col("w"), ["i"]).orderBy("i").collect()
    assert sum(r["allocated"] for r in got) == total


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 9), min_size=1, max_size=6), st.integers(0, 500))
def test_every_rule_keeps_the_total(spark, weights, total):
    rows = spark.createDataFrame([("g", i, w) for i, w in enumerate(weights)], "g string, i int, w long")
    t = F.lit(total).cast("long")
    for rule in (allocation.last_takes_rest, allocation.earliest_units, allocation.largest_remainder):
        assert rule(rows, ["g"], t, F.col("w"), ["i"]).agg(F.sum("allocated")).first()[0] == total


def test_equal_facts_are_duplicates_and_different_ones_conflict(spark):
    rows = spark.createDataFrame([("a", 1, None), ("b", 1, None), ("b", 1, None), ("c", 1, None), ("c", 1, 2)], "k string, x int, y int")
    got = {r["k"]: (r["evidence"], r["x"]) for r in changes.resolve_facts(rows, "k", ["x", "y"]).collect()}
    assert got == {"a": ("AVAILABLE", 1), "b": ("DUPLICATE", 1), "c": ("CONFLICTING", None)}


def test_null_differs_from_empty_text_in_a_snapshot(spark):
    old = spark.createDataFrame([("1", None), ("2", "x"), ("3", "x")], "k string, v string")
    new = spark.createDataFrame([("1", ""), ("2", "x"), ("4", "x")], "k string, v string")
    assert {r["k"]: r["change"] for r in changes.classify(old, new, ["k"]).collect()} == {"1": "UPDATED", "2": "UNCHANGED", "3": "RETAINED", "4": "NEW"}


def test_bundles_ignore_the_order_of_rows(spark):
    schema = "k string, line int, v int"
    old = spark.createDataFrame([("1", 1, 1), ("1", 2, 2), ("2", 1, 1), ("3", 1, 1), ("3", 2, 1), ("5", 1, 1), ("5", 2, 1)], schema)
    new = spark.createDataFrame([("1", 2, 2), ("1", 1, 1), ("2", 1, 5), ("3", 1, 1), ("4", 1, 1), ("5", 1, 1), ("5", 3, 1)], schema)
    verdicts = {r["k"]: r["verdict"] for r in changes.classify_bundles(old, new, "k", ["line", "v"]).collect()}
    assert verdicts == {"1": "EXACT_DUPLICATE", "2": "CONFLICT", "3": "UNSAFE", "4": "NEW", "5": "UNSAFE"}  # 5: as many rows, but other ones


def test_a_stronger_tier_is_final(spark):
    master = spark.createDataFrame([("a", "n", D("1.00"), "p"), ("a", "m", D("2.00"), "q"), ("b", "n", D("3.00"), "r")], "sku string, name string, unit_price decimal(18,2), product string")
    rows = spark.createDataFrame([("a", "n"), ("b", "x"), ("c", "m"), ("d", "y")], "sku string, name string")
    got = {r["sku"]: (r["tier"], r["outcome"], r["master_price"]) for r in products.lookup(rows, master, [("SKU", ["sku"]), ("NAME", ["name"])], "sku").collect()}
    assert got == {"a": ("SKU", "CONFLICT", None), "b": ("SKU", "MATCHED", D("3.00")), "c": ("NAME", "MATCHED", D("2.00")), "d": ("NOT_FOUND", "NOT_FOUND", None)}


def test_violations_raise(spark):
    rows = spark.createDataFrame([("MY", "1", "1.005"), ("SG", "1", "1.00")], "market string, id string, t string").withColumn("x", F.col("t").cast("decimal(18,4)"))
    guards.require_none(orphans=guards.orphans(rows, rows, ["id"]))
    for bad in (guards.duplicates(rows, ["id"]), guards.foreign_rows(rows, "market", "MY"), guards.off_cent(rows, F.col("x"))):
        with pytest.raises(guards.InvariantError):
            guards.require_none(bad=bad)
    with pytest.raises(Exception, match="whole cent"):
        rows.select(casts.exact_money(F.col("x"))).collect()


def test_casts_of_written_amounts(spark):
    rows = spark.createDataFrame([("RM 1,234.50",), ("",), (None,), ("x 12 y",), ("(3.00)",)], "t string")
    got = [tuple(r) for r in rows.select(casts.lenient_money(F.col("t")), casts.lenient_quantity(F.col("t")), casts.strict_price(F.col("t")), casts.statement_money(F.col("t"))).collect()]
    assert [r[0] for r in got] == [D("1234.50"), D("0.00"), D("0.00"), D("12.00"), D("3.00")]
    assert [r[1] for r in got] == [1234, 0, 0, 12, 3]
    assert got[0][2] == D("1234.50") and got[3][2] is None
    assert got[0][3] == D("1234.50") and got[4][3] == D("-3.00") and got[1][3] is None


def test_text_keys(spark):
    rows = spark.createDataFrame([("Ｆｕｌｌ　Straße ",), ("4006381333931",), ("4006381333932",), (None,)], "t string")
    got = rows.select(text.match_key("t").alias("k"), text.is_ean13(F.col("t")).alias("e")).collect()
    assert [r["k"] for r in got] == ["fullstrasse", "4006381333931", "4006381333932", None]
    assert [r["e"] for r in got] == [False, True, False, False]
    months = spark.createDataFrame([(date(2024, 2, 1), date(2024, 2, 29)), (date(2024, 2, 1), date(2024, 2, 28))], "a date, b date")
    assert [r[0] for r in months.select(text.period_label(F.col("a"), F.col("b"))).collect()] == ["February 2024", "2024-02-01 → 2024-02-28"]


def test_first_seen_and_continuations(spark):
    rows = spark.createDataFrame([("d", 0, "a", False), ("d", 1, "b", True), ("d", 2, "c", False)], "doc string, place int, t string, more boolean")
    got = products.continued_rows(rows, ["place"], "doc", F.col("more"), "t").orderBy("t").collect()
    assert [(r["t"], r["n_parts"]) for r in got] == [("a b", 2), ("c", 1)]
    assert rows.agg(products.first_seen(F.when(F.col("place") == 1, "a").otherwise(F.col("t")), F.col("place")).alias("s")).first()["s"] == ["a", "c"]


def test_a_feed_of_changes_gives_the_facts_of_one_pass(spark, tmp_path):
    from tallymill.streaming import facts

    parts = spark.createDataFrame([("1", "Product Price", D("5.00")), ("2", "Product Price", D("6.00")), ("2", "Fee", D("-1.00"))], COMPONENT)
    whole = analysis.component_facts(parts)
    schema = whole.schema.simpleString()[7:-1].replace(":", " ")
    feed = str(tmp_path / "feed")
    spark.createDataFrame([("1", 1), ("2", 2), ("9", 3)], "order_id string, revision long").write.parquet(feed)
    for _ in range(2):
        stream = spark.readStream.schema("order_id string, revision long").parquet(feed)
        facts.follow(stream, parts, (tmp_path / "facts").as_uri(), str(tmp_path / "check"), schema).awaitTermination(120)
    assert guards.differences(facts.newest(spark, (tmp_path / "facts").as_uri(), schema), whole).count() == 0
    changes_ = spark.createDataFrame([("1", 1), ("1", 3)], "order_id string, revision long")
    assert [r[0] for r in facts.coverage_gaps(changes_, 1, 3).collect()] == [2]
    assert facts.pending(changes_).first()["revision"] == 3


def test_perfect_matchings_are_counted():
    import random
    from itertools import permutations

    r = random.Random(3)
    for _ in range(200):
        n = r.randint(0, 5)
        edges = [{j for j in range(n) if r.random() < 0.6} for _ in range(n)]
        assert matching.perfect_matchings(edges, n) == sum(all(p[i] in edges[i] for i in range(n)) for p in permutations(range(n)))
    assert matching.perfect_matchings([{0}], 2) == 0
    assert matching.perfect_matchings([set(range(30))] * 30, 30) == math.factorial(30)  # equal items are one kind
    many = [{(r + k) % 40 for k in (0, 1, 3, 7, 12, 20, 29)} for r in range(40)]
    assert matching.perfect_matchings(many, 40) == 2 and matching.perfect_matchings([{0}, {0}, *many[2:]], 40) == 0


def test_rows_are_resolved_to_items_or_groups(spark):
    schema = "order_id string, product_key string, {} int, amount decimal(18,2)"
    rows = spark.createDataFrame([("1", "p", 1, D("5.00")), ("1", "p", 2, D("9.00")), ("2", "p", 1, D("5.00")), ("2", "p", 2, D("5.00")), ("3", "p", 1, D("5.00")), ("4", "p", 1, D("5.03"))], schema.format("row_no"))
    items = spark.createDataFrame([("1", "p", 0, D("9.01")), ("1", "p", 1, D("5.02")), ("2", "p", 0, D("5.00")), ("2", "p", 1, D("5.00")), ("4", "p", 0, D("5.00"))], schema.format("item_index"))
    got = {r["order_id"]: (r["outcome"], r["n_matchings"]) for r in matching.resolve(rows, items).collect()}
    assert got == {"1": ("ITEM", 1), "2": ("GROUP", 2), "3": ("UNRESOLVED", 0), "4": ("UNRESOLVED", 0)}


def test_a_second_upsert_changes_nothing(spark):
    old = spark.createDataFrame([("1", None), ("2", "x")], "k string, v string")
    new = spark.createDataFrame([("1", None), ("2", "y"), ("3", None)], "k string, v string")
    assert {(r["k"], r["action"]) for r in matching.upsert_changes(old, new, ["k"]).collect()} == {("2", "UPDATE"), ("3", "INSERT")}
    assert matching.upsert_changes(changes.merge(old, new, ["k"]), new, ["k"]).count() == 0


def test_invoice_checks_name_the_first_problem(spark):
    item = "order_id string, item_index int, quantity int, price decimal(18,2), total decimal(18,2), label string, promotion string, group_total decimal(18,2)"
    items = spark.createDataFrame(
        [
            ("fine", 0, 2, D(5), D("10.02"), None, None, None),
            ("item", 0, 2, D(5), D("10.03"), None, None, None),
            ("label", 0, 2, D(5), D("9.00"), "ANY 2 at RM 9.00", "", None),
            ("group", 0, 1, D(5), None, None, "p", D(8)),
            ("group", 1, 1, D(5), None, None, "p", D(8)),
            ("group", 2, 1, D(3), D(3), None, None, D(3)),
            ("nulls", 0, None, None, None, None, None, None),
            ("base", 0, 1, D(4), D(4), None, None, None),
        ],
        item,
    )
    rows = [("fine", D(10), None, None), ("item", D(10), None, None), ("label", D(9), D(9), None), ("group", D(11), D(11), None), ("nulls", D(1), D(1), None), ("base", D(3), D(4), D("-0.50")), ("none", D(1), None, None)]
    invoices = spark.createDataFrame(rows, "order_id string, merchandise decimal(18,2), product_price decimal(18,2), refund decimal(18,2)")
    found = {r["order_id"]: r["problem"] for r in invoice_checks.product_amounts(invoices, items).collect()}
    assert found == {"fine": None, "item": "ITEM_TOTAL", "label": None, "group": None, "nulls": None, "base": "MERCHANDISE", "none": None}

    gone = spark.createDataFrame([("base", D(4), D(-4), D(0), D(0), None), ("fine", D("10.02"), None, None, None, None), ("none", None, D(-1), None, D(0), D(0))], "order_id string, product_price decimal(18,2), cancelled decimal(18,2), merchandise decimal(18,2), order_income decimal(18,2), final_amount decimal(18,2)")
    found = {r["order_id"]: r["problem"] for r in invoice_checks.cancelled_amounts(gone, items).collect()}
    assert found == {"base": "FINAL_AMOUNT_MISSING", "fine": "CANCELLED_MISSING", "none": "MERCHANDISE_MISSING"}
    assert invoice_checks.product_amounts(invoices.limit(0), items.limit(0)).count() == 0


def test_exact_name_lookup_narrows_by_sku_only(spark):
    records = spark.createDataFrame([(1, "a", "Tea Pot", "Red"), (2, "b", "teapot", "red "), (3, "b", "Cup", None), (4, "c", "Jar", ""), (5, "c", "Jar", " "), (6, "x", " ", "")], "source_row int, sku string, name string, variation string")
    rows = spark.createDataFrame([("a", "TEA POT", "RED"), ("z", "Tea pot", "red"), (None, "cup", ""), ("c", "Jar", None), ("x", "", ""), ("b", "Cup", "blue"), (None, None, None)], "sku string, name string, variation string")
    found = [(r["name"], r["variation"], r["outcome"], r["source_row"]) for r in products.exact_name_lookup(rows, records).collect()]
    assert sorted(found, key=str) == sorted(
        [
            ("TEA POT", "RED", "MATCHED_BY_SKU_NAME_VARIATION", 1),
            ("Tea pot", "red", "CONFLICT", None),
            ("cup", "", "MATCHED_BY_NAME_VARIATION", 3),
            ("Jar", None, "CONFLICT", None),
            ("", "", "NOT_FOUND", None),
            ("Cup", "blue", "NOT_FOUND", None),
            (None, None, "NOT_FOUND", None),
        ],
        key=str,
    )


# identity resolution

ROW = "order_id string, row_no int, product_id string, name string, price decimal(18,2)"
ITEM = "order_id string, item_index int, sku string, name string, variation string, nav string, quantity int, unit_price decimal(18,2), subtotal decimal(18,2), promotion string, label string, group_total decimal(18,2)"
FAMILY = "product_id string, sku string, parent_sku string, name string, variation string, nav string, price decimal(18,2)"


def _resolved(spark, rows, items, families):
    found = reconciliation.identities(spark.createDataFrame(rows, ROW), spark.createDataFrame(items, ITEM), spark.createDataFrame(families, FAMILY))
    return {(r["order_id"], r["row_no"]): (r["scope"], r["item_index"], r["members"], r["diagnostic"]) for r in found.collect()}


def _item(order, index, sku="S1", name="A", variation="V", nav="N1", quantity=1, price="5", subtotal="5", promotion=None, label=None, total=None):
    return (order, index, sku, name, variation, nav, quantity, D(price), D(subtotal), promotion, label, None if total is None else D(total))


LISTED = [("P1", "S1", "K1", "A", "V", "N1", D(5)), ("P2", "S2", "K2", "B", "V", "N2", D(7)), ("P2", "S1", "K2", "A", "V", "N1", D(5))]


def test_rows_that_the_graph_decides_get_their_item(spark):
    """Row 0 may have items 0 and 1, row 1 only item 1 (by a name of its own): one way is left."""
    listed = [("P1", "S1", None, "A", "V", "N", D(1)), ("P1", "S2", None, "B", "V", "N", D(1))]
    items = [_item("o", 0, "S1", "X"), _item("o", 1, "S2", "Y"), _item("o", 2, "S2", "Z", subtotal="9")]
    rows = [("o", 0, "P1", "A", D(3)), ("o", 1, "P1", "B", D(3)), ("o", 2, "P1", "B", D(3))]
    got = _resolved(spark, rows, items, listed)
    assert got["o", 0] == ("ITEM", 0, [0], "PREFERRED")  # only S1's listing has its name
    assert got["o", 1] == got["o", 2] == ("GROUP", None, [1, 2], "SEVERAL_ALLOCATIONS")
    # 0: items 0 and 1, 1: items 1 and 2, 2: items 1 and 2 by two families of names
    listed = [("P1", "S1", None, "A", "V", "N", D(1)), ("P1", "S2", None, "A", "V", "N", D(1)), ("P1", "S2", None, "B", "V", "N", D(1)), ("P1", "S3", None, "B", "V", "N", D(1))]
    items = [_item("o", 0, "S1", "X", subtotal="8"), _item("o", 1, "S2", "Y", subtotal="8"), _item("o", 2, "S3", "Z", subtotal="8")]
    rows = [("o", 0, "P1", "A", D(3)), ("o", 1, "P1", "B", D(3)), ("o", 2, "P1", "C", D(3))]
    got = _resolved(spark, rows, items, listed)
    assert got["o", 2] == ("UNRESOLVED", None, [], "NAME_CONFLICT")
    assert got["o", 0][0] == got["o", 1][0] == "UNRESOLVED"  # three items for two rows


def test_an_order_s_products_take_their_items_in_order(spark):
    """P1's two rows need both items that P2's rows could have, too: P2 gets nothing of them."""
    items = [_item("o", 0), _item("o", 1), _item("o", 2, "S2", "B", nav="N2", subtotal="7")]
    rows = [("o", 0, "P1", "A", D(1)), ("o", 1, "P1", "A", D(1)), ("o", 2, "P2", "A", D(1)), ("o", 3, "P2", "A", D(1))]
    got = _resolved(spark, rows, items, LISTED)
    assert got["o", 0] == got["o", 1] == ("GROUP", None, [0, 1], "SEVERAL_ALLOCATIONS")
    assert got["o", 2] == got["o", 3] == ("UNRESOLVED", None, [], "NO_ALLOCATION")


def test_promotion_groups(spark):
    """One thing in a promotion, fewer rows than items: proven as a group; any gap in the evidence undoes it."""
    rows = [("o", 0, "P1", "A", D(9))]
    sold = [_item("o", 0, promotion="g", label="3 for 2", total="9"), _item("o", 1, promotion="g", label="3 for 2", total="9"), _item("o", 2)]
    one = LISTED[:1]
    assert _resolved(spark, rows, sold, one)["o", 0] == ("GROUP", None, [0, 1, 2], "PROMOTION_GROUP")
    broken = [
        (sold[:1] + [_item("o", 1, promotion="g")] + sold[2:], one),  # no total
        ([*sold[:2], _item("o", 2, quantity=0)], one),
        ([*sold[:2], _item("o", 2, nav="N9")], one),
        (sold, [("P1", "S1", "K1", "A", "V", "N1", D(6))]),  # the listing has another price
        (sold[2:] + [_item("o", 0), _item("o", 1)], one),  # no promotion
    ]
    for items, listed in broken:
        assert _resolved(spark, rows, items, listed)["o", 0] == ("UNRESOLVED", None, [], "NO_ALLOCATION")
    both = [*rows, ("o", 1, "P2", "B", D(9))]
    assert _resolved(spark, both, sold, LISTED)["o", 0][0] == "UNRESOLVED"  # P2 lists the items, too


def test_family_tiers(spark):
    """Parent SKUs only where no item has one of the family's, names with variation only after those."""
    listed = [("P", "S1", "K", "A", "V", "N", D(1)), ("P", "S2", "K", "A", "W", "N", D(1))]
    items = [_item("all", 0), _item("all", 1, "K"), _item("all", 2, "", variation="W"), _item("parent", 0, "K"), _item("parent", 1, ""), _item("name", 0, "", " a"), _item("name", 1, "", "A", "X"), _item("name", 2, None, "A", "w ")]
    rows = [(o, 0, "P", "A", D(1)) for o in ("all", "parent", "name")]
    found = reconciliation.family_items(spark.createDataFrame(rows, ROW), spark.createDataFrame(items, ITEM), spark.createDataFrame(listed, FAMILY))
    got = sorted((r["order_id"], r["item_index"], r["method"]) for r in found.collect())
    assert got == [("all", 0, "PRODUCT_MASTER_SKU"), ("name", 0, "PRODUCT_MASTER_NAME_VARIATION"), ("name", 2, "PRODUCT_MASTER_NAME_VARIATION"), ("parent", 0, "PRODUCT_MASTER_PARENT_SKU")]


def test_assignment_of_a_long_chain():
    """Thousands of rows that all have to move: no recursion."""
    n = 3000
    edges = [{i, i + 1} for i in range(n - 1)] + [{0}]
    assert matching.assignment(edges) == {**{i: i + 1 for i in range(n - 1)}, n - 1: 0}
    assert matching.assignment([{0}, {0}]) is None


def test_identities_of_nothing(spark):
    assert _resolved(spark, [], [], []) == {}
    assert _resolved(spark, [("o", 0, "P", "A", None)], [], LISTED) == {("o", 0): ("UNRESOLVED", None, [], "NO_CANDIDATE")}


def test_titles_in_compatibility_form(spark):
    given = ["Ｆｒｅｅ　Gift", "PRE-ORDER  Be st tea", "茶 叶 x 茶  叶", "ﬁne tea", "pre-orders", None, " "]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in given], "t string").select(text.title(F.col("t"))).collect()]
    assert got == ["Free Gift", "Best tea", "茶叶 x 茶叶", "fine tea", "pre-orders", "", ""]


def test_revisions_follow_on_the_version_before(spark, tmp_path):
    """A revision that no batch has brought is a gap, also between two batches; a batch may be run again."""
    from tallymill.streaming import facts

    parts = spark.createDataFrame([("a", "Fee", D(-1)), ("b", "Fee", D(-2))], COMPONENT)
    empty = analysis.component_facts(parts.where("false"))
    folder = (tmp_path / "facts").as_uri()
    run = facts.publish(parts, folder, empty.schema.simpleString()[7:-1].replace(":", " "))
    feed = lambda *rows: spark.createDataFrame(rows, "order_id string, revision long")
    run(feed(("a", 1), ("a", 2)), 0)
    with pytest.raises(guards.InvariantError):
        run(feed(("b", 4)), 1)
    run(feed(("b", 3), ("a", 2)), 1)
    run(feed(("b", 3), ("a", 2)), 1)
    assert facts.last_revision(spark, folder, 9) == 3 and facts.last_revision(spark, folder, 1) == 2 and facts.last_revision(spark, folder, 0) is None


def test_work_items_keep_all_issues(spark):
    schema = "position long, layer string, reason string, blocking boolean, order_id string, source string, of_statement boolean, actions array<struct<label:string,destructive:boolean,allowed:boolean>>"
    look, drop = ("Look", False, True), ("Drop", True, True)
    rows = [(1, "price", "o1: too low", False, " o1 ", "a", False, [look, ("No", True, False)]), (2, "duplicate", "seen", False, "o1", "a", False, [drop]), (0, "price", "x", True, "", None, None, None), (3, "manual_review", "o1:again", True, "o1", "b", True, [look])]
    rows += [(4, "price", "row", False, None, "a", True, [look, drop]), (5, "price", "row", False, None, "a", True, []), (6, "name", "bad", False, None, "a", False, []), (7, "name", "bad", False, None, "a", None, []), (8, "duplicate", "seen", None, None, "b", False, [drop, look])]
    issues = spark.createDataFrame(rows, schema)
    queue = changes.work_queue(issues)
    got = {r["key"]: (r["scope"], r["title"], r["summary"], r["n_issues"], r["blocking"], r["source"], r["actions"], r["hint"]) for r in queue.collect()}
    assert got == {
        "order:o1": ("Order", "o1", "too low +1 more", 2, True, "a", ["Look"], "Review form below"),
        "category:duplicate": ("Source", "Duplicate sources", "seen +1 more", 2, False, None, ["Drop", "Look"], "Drop"),
        "other:0": ("Other", "Current batch", "x", 1, True, None, [], "View details"),
        "statement:4": ("Statement", "a", "row", 1, False, "a", ["Look", "Drop"], "Drop"),
        "statement:5": ("Statement", "a", "row", 1, False, "a", [], "View details"),
        "source:name:a": ("Source", "a", "bad +1 more", 2, False, "a", [], "View details"),
    }
    assert changes.lost_issues(issues, queue).count() == 0 and changes.lost_issues(issues, queue.where("n_issues > 1")).count() == 1
    assert changes.lost_issues(issues.where("false"), changes.work_queue(issues.where("false"))).count() == 0


def test_family_rows_are_keyed_and_shuffled_by_order_once(spark, tmp_path):
    from tallymill.plans import relations

    rows, items, families = relations.family_rows(spark, "/root/testdata/sf0.001")
    assert {"name_key"} <= set(rows.columns) and {"name_key", "variation_key"} <= set(items.columns)
    assert sorted(rows.inputFiles()) == sorted(items.inputFiles())  # one stored table
    (listed,) = reconciliation.stored_keys(families)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with more orders than are broadcast
    try:
        plan = reconciliation.family_items(rows, items, listed)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffles = [x.split("hashpartitioning(")[1].split("]")[0] for x in plan.splitlines() if "hashpartitioning(" in x]
    by_order = [x for x in shuffles if "order_id" in x]
    assert by_order and all(x.startswith("order_id") and "product_id" not in x and "item_index" not in x for x in by_order)


def test_tables_by_order_are_joined_and_grouped_without_a_shuffle(spark):
    from tallymill.sources.stored import ALL_KEYS, stored

    before = spark.conf.get(ALL_KEYS)
    rows = spark.range(400).select((F.col("id") % 50).cast("string").alias("order_id"), (F.col("id") % 7).alias("line"), "id")
    a, b = (stored(rows.repartition("order_id"), "by-order-test", "order_id") for _ in range(2))
    assert spark.conf.get(ALL_KEYS) == before
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = a.join(b.select("order_id", F.col("line").alias("theirs")), "order_id").groupBy("order_id", "line").count()
        assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
        both = stored(a.join(b.withColumnRenamed("id", "other"), ["order_id", "line"]), "by-order-test", "order_id")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert both.count() == rows.join(rows.withColumnRenamed("id", "other"), ["order_id", "line"]).count()
    assert sorted(a.collect()) == sorted(rows.collect())


def test_an_item_meets_each_product_once_a_tier(spark):
    item = ("o1", 0, "S1", "Bag", "Red", "n1", 1, 10, 10, None, None, None)
    listed = [("P1", "S1", "K", "Bag", "Red", "n1", 10), ("P1", "S1", "K", "Bag two", "Red", "n2", 10), ("P2", "X", "S1", "Other", "Red", "n1", 10)]
    items = spark.createDataFrame([(*item[:7], *(D(x) for x in item[7:9]), *item[9:])], ITEM)
    families = spark.createDataFrame([(*x[:6], D(x[6])) for x in listed], FAMILY)
    rows = spark.createDataFrame([("o1", 0, "P1", "Bag", D(10)), ("o1", 1, "P2", "Other", D(10))], ROW)
    found = {x["product_id"]: x for x in reconciliation.family_items(rows, items, families).collect()}
    assert {k: (x["method"], sorted(x["family_names"]), x["agrees"], x["n_products"]) for k, x in found.items()} == {
        "P1": ("PRODUCT_MASTER_SKU", ["bag", "bag two"], False, 2),
        "P2": ("PRODUCT_MASTER_PARENT_SKU", ["other"], True, 2),
    }
