"""Promotion totals and what statements say, on hand-made rows and against brute force."""

import itertools
import random
import zipfile
from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallymill.operators import overlap, promotions
from tallymill.sources import statement, workbook

MEMBER = "order_id string, group_id string, group_total decimal(18,2), status string, advertised decimal(18,2)"
CANDIDATE = "order_id string, group_id string, candidate string, amount decimal(18,2), struck boolean, top double, left double"
ORDER = "order_id string, subtotal decimal(18,2), normal decimal(18,2), normal_missing boolean"


def test_one_choice_against_all_choices():
    r = random.Random(3)
    for _ in range(600):
        sets = [[r.choice([r.randint(0, 30), r.randint(-5, 900)]) for _ in range(r.randint(1, 4))] for _ in range(r.randint(1, 6))]
        target = sum(r.choice(s) for s in sets) + r.choice([0, 0, 2, 3, -2, 50])
        ways = [w for w in itertools.product(*(range(len(s)) for s in sets)) if abs(sum(s[i] for s, i in zip(sets, w, strict=True)) - target) <= 2]
        got = promotions.one_choice(sets, target)
        assert got == ((1, ways[0]) if len(ways) == 1 else (min(2, len(ways)), ()))


def test_many_groups_meet_in_the_middle(monkeypatch):
    """30 groups of two amounts: 2^30 choices, of which powers of two make one right."""
    sets = [[0, 3 << i] for i in range(30)]
    assert promotions.one_choice(sets, sum(3 << i for i in range(0, 30, 2))) == (1, tuple(1 - i % 2 for i in range(30)))
    assert promotions.one_choice([[5, 5]] * 60, 300) == (2, ())  # equal amounts are different choices
    monkeypatch.setattr(promotions, "STATES", 100)
    assert promotions.one_choice(sets, 3) is None
    assert promotions.one_choice([[1, 200]] * 60, 60) == (1, (0,) * 60)  # few different sums, whatever the choices


def test_candidate_sets(spark):
    members = [("o", "fixed", D(9), "resolved", None), ("o", "fixed", D(9), "resolved", None), ("o", "half", D(9), "resolved", None), ("o", "half", None, None, None), ("o", "two", D(8), "manual", None), ("o", "two", D(9), "manual", None)]
    members += [("o", "hand", D(7), "manual", None), ("o", "alike", None, None, D(5)), ("o", "far", None, None, D(5)), ("o", "bare", None, None, None)]
    listed = [("o", "fixed", "x", D(1), False, 1.0, 1.0), ("o", "half", "a", D(1), False, None, None), ("o", "half", "a", D(1), False, None, None), ("o", "half", "b", D(2), True, None, None), ("o", "two", "c", D(3), None, None, None)]
    listed += [("o", "alike", "d", D(5), False, 2.0, 1.0), ("o", "alike", "e", D(5), False, 1.0, 9.0), ("o", "far", "f", D(5), False, None, None), ("o", "far", "g", D(5), False, 1.0, 1.0), ("o", "bare", "h", None, False, None, None)]
    got = promotions.candidate_sets(spark.createDataFrame(members, MEMBER), spark.createDataFrame(listed, CANDIDATE))
    assert sorted(((r["group_id"], r["candidate"], r["amount"]) for r in got.collect()), key=str) == sorted(
        [("fixed", "certified:fixed", D(9)), ("half", "a", D(1)), ("two", "c", D(3)), ("hand", "manual:hand", D(7)), ("alike", "equivalent:e", D(5)), ("far", "f", D(5)), ("far", "g", D(5)), ("bare", None, None)], key=str
    )


def test_certified_totals(spark):
    sets = [("one", "a", "x", D(5)), ("one", "a", "y", D(6)), ("one", "b", "z", D(2)), ("both", "a", "x", D(5)), ("both", "a", "y", D("5.01")), ("none", "a", "x", D(5)), ("bare", "a", "x", D(5)), ("bare", "b", None, None), ("lost", "a", "x", D(5)), ("gap", "a", "x", D(5)), ("alone", "a", "x", D(5))]
    orders = [("one", D("18.02"), D(10), False), ("both", D(5), None, False), ("none", D("5.03"), D(0), False), ("bare", D(5), D(0), False), ("lost", None, D(0), True), ("gap", D(5), D(0), True)]
    got = promotions.certified_totals(spark.createDataFrame(orders, ORDER), spark.createDataFrame(sets, "order_id string, group_id string, candidate string, amount decimal(18,2)"))
    assert sorted(((r["order_id"], r["outcome"], r["group_id"], r["candidate"], r["amount"]) for r in got.collect()), key=str) == sorted(
        [("one", "CERTIFIED", "a", "y", D(6)), ("one", "CERTIFIED", "b", "z", D(2)), *((o, w, None, None, None) for o, w in (("both", "SEVERAL_COMBINATIONS"), ("none", "NO_COMBINATION"), ("bare", "NO_CANDIDATE"), ("lost", "NO_SUBTOTAL"), ("gap", "NORMAL_MISSING"), ("alone", "NO_SUBTOTAL")))],
        key=str,
    )


# statement sheets, from workbooks

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def write_workbook(path, sheets):
    cell = lambda r, c, v: f'<c r="{chr(65 + c) if c < 26 else "A" + chr(39 + c)}{r}" t="inlineStr"><is><t xml:space="preserve">{v.replace("&", "&amp;")}</t></is></c>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{LINKS}"><sheets>' + "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, rows in enumerate(sheets.values()):
            body = "".join(f'<row r="{n}">{"".join(cell(n, c, v) for c, v in enumerate(r) if v is not None)}</row>' for n, r in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {MAIN}><sheetData>{body}</sheetData></worksheet>")


def summary(market="MY", amounts=None, place=2):
    rows = [["Some shop"], [None, "INCOME  summary", None, "RM"]]
    for x in statement.summary_contract(market):
        row = [None] * 4
        row[x.column] = x.label
        if x.kind != "SECTION_HEADER":
            row[place if place == 2 or x.column else 3] = (amounts or {}).get(x.label, "0.00")
        rows.append(row)
    return rows


def codes(found):
    return sorted((r["code"], r["detail"]) for r in found.collect())


def test_summary_is_a_tree(spark, tmp_path):
    amounts = {"1. Total Revenue": "RM 12.00", "Merchandise Subtotal": "10.00", "Original product price": "11.00", "Refund Amount": "(1.00)", "Voucher & Rebates": "2.00", "Rebate Provided by Shopee": "2.01", "3. Total Released Amount": "1,200.00"}
    write_workbook(tmp_path / "a.xlsx", {"Summary": summary(amounts=amounts)})
    lines, violations = statement.summary_lines(workbook.read_cells(spark, str(tmp_path)), "MY")
    assert violations.count() == 0
    got = {r["label"]: r for r in lines.collect()}
    assert len(got) == 32 and {r["currency"] for r in got.values()} == {"RM"}
    row = lambda label: got[label]["row"]
    assert got["Refund Amount"]["parent_row"] == row("Merchandise Subtotal") and got["Refund Amount"]["amount"] == D("-1.00")
    assert got["Voucher & Rebates"]["parent_row"] == row("1. Total Revenue") and got["2. Total Expenses"]["parent_row"] is None
    assert got["Shipping Fee Promotion by Seller"]["parent_row"] == row("Other Reference Values") and got["Other Reference Values"]["amount"] is None
    off = {r["label"]: r["difference"] for r in statement.control_sums(lines).where("difference <> 0").collect()}
    assert off == {"Voucher & Rebates": D("-0.01"), "3. Total Released Amount": D("1188.00")}


def test_summary_of_the_other_market_may_have_more_numbers(spark, tmp_path):
    rows = summary("SG", {"Refund Amount": "5.00"}, place=2)
    for r in rows[2:]:
        if r[1] is not None:
            r[3] = "99"  # beside a detail's amount
        elif r[2] is not None:
            r[2:] = ["98", r[2]]  # a total's amount is in the last column
    write_workbook(tmp_path / "a.xlsx", {"Summary": rows})
    lines, violations = statement.summary_lines(workbook.read_cells(spark, str(tmp_path)), "SG")
    assert violations.count() == 0 and lines.count() == 34
    assert lines.where("label = 'Refund Amount'").first()["amount"] == D("5.00") and lines.where("kind = 'TOTAL' AND amount <> 0").count() == 0


@pytest.mark.parametrize(
    "change,expected",
    [
        (lambda rows: rows.pop(1), [("ANCHOR", "0")]),
        (lambda rows: rows.append(["Income Summary"]), [("ANCHOR", "2")]),
        (lambda rows: rows[1].pop(), [("CURRENCY", "0")]),
        (lambda rows: rows.pop(5), [("MISSING_LINE", "Your Seller product promotion")]),
        (lambda rows: rows.append(["News", None, "1"]), [("UNSUPPORTED_LINE", "News")]),
        (lambda rows: rows[4].__setitem__(3, "extra"), [("NO_AMOUNT", "Original product price")]),
        (lambda rows: rows[4].__setitem__(2, "many"), [("NO_AMOUNT", "Original product price")]),
        (lambda rows: rows[4].__setitem__(0, "refund amount"), [("MISSING_LINE", "Original product price"), ("SEVERAL_MEANINGS", "refund amount")]),
        (lambda rows: rows[32].__setitem__(3, "1"), [("HEADER_WITH_AMOUNT", "Other Reference Values")]),
        (lambda rows: rows.__setitem__(4, [rows[4][1], None, "0"]), [("WRONG_COLUMN", "Original product price")]),
        (lambda rows: rows.append(["2. total  expenses", None, "0"]), [("DUPLICATE_LINE", "2. Total Expenses"), ("DUPLICATE_LINE", "2. Total Expenses"), ("OUT_OF_ORDER", "2. Total Expenses")]),
        (lambda rows: rows.insert(13, rows.pop(7)), [("OUT_OF_ORDER", "Voucher & Rebates"), *[("WRONG_PARENT", x) for x in ("Cofund Coin Cashback Sponsored by Seller", "Cofund Voucher Sponsored by Seller", "Coin Cashback Sponsored by Seller", "Rebate Provided by Shopee", "Voucher & Rebates", "Voucher Sponsored by Seller")]]),
    ],
)
def test_what_is_wrong_with_a_summary(spark, tmp_path, change, expected):
    rows = summary()
    change(rows)
    write_workbook(tmp_path / "a.xlsx", {"Summary": rows})
    _, violations = statement.summary_lines(workbook.read_cells(spark, str(tmp_path)), "MY")
    assert codes(violations) == expected


def test_income_rows_on_both_sides_of_their_header(spark, tmp_path):
    names = statement.COMPONENTS["MY"].strip().splitlines()
    header = [n.upper() for n in (*statement.INCOME_KEYS, statement.RELEASED["MY"], *names)]
    order = ["1", "Order", "o1", None, None, "2024-01-02T03:04:05", "2024-01-09", "Bank", "Normal", "RM 1,000.50", "(5.00)", *["0"] * 20]
    bad = ["2", "Order", "o2", None, None, "2 Jan", None, None, None, "-", *["1"] * 19, "x", None]
    other = ["3", "Total", None, None, None, None, None, None, None, "7"]
    sku = ["4", " Sku ", "o1", "p", "Name", "2024-01-02", "2024-01-09", None, None, "3"]
    write_workbook(tmp_path / "a.xlsx", {"Income": [["Order info", None, None, None, None, "Released  amount details"], order, [], header, bad, other, sku]})
    write_workbook(tmp_path / "b.xlsx", {"Income": [header[:-1], order]})
    rows, issues, violations = statement.income_rows(workbook.read_cells(spark, str(tmp_path)), "MY")
    got = {r["sequence_no"]: r for r in rows.collect()}
    assert sorted(got) == ["1", "2", "3", "4"] and [r["code"] for r in violations.collect()] == ["NO_HEADER"]
    assert (got["1"]["created"], got["1"]["released"], got["1"]["components"]["Product Price"]) == (date(2024, 1, 2), D("1000.50"), D("-5.00"))
    assert set(got["4"]["components"]) == set(names) and set(got["4"]["components"].values()) == {None} and got["4"]["view_by"] == "Sku"
    assert sorted((r["row"], r["code"], r["column"]) for r in issues.collect()) == [
        (5, "invalid_financial_component", names[-1]), (5, "invalid_financial_component", names[-2]), (5, "invalid_order_creation_date", "Order Creation Date"),
        (5, "invalid_payout_completed_date", "Payout Completed Date"), (5, "invalid_total_released", "Total Released Amount (RM)"), (6, "unrecognized_income_row", "View By"),
    ]
    assert statement.components(rows, F.lit("ORDER")).count() == 4 * 21


def test_columns_that_the_header_names(spark, tmp_path):
    """A column without an amount is NULL, a column that isn't there is no key."""
    one = {"Service Fee Details": [["x"], ["sequence no.", "Order ID", "Service Fee", "Campaign", "Service  Fee"], ["1", "o1", "-2.50", None, "9"], ["2", None, "free"]], "Shipping Fee Discrepancy": [list(statement.SHIPPING_KEYS), ["o1", "5", "(6.00)", " weight "], ["o2", None, "?"]]}
    two = {"Service Fee Details": [["Order ID", "Sequence No.", "Other"], ["o3", "1", "1"]], "Adjustment": [list(statement.ADJUSTMENT_KEYS), ["1", "2024-05-01", "Kind", "Why", "-3", "o1", "soon"], ["TOTAL amount", None, None, None, "-3"], ["2", "2024-05-01", "Kind", "Why", "1", "o2", None]]}
    three = {"Service Fee Details": [["Order ID", "Sequence No."], ["o4", "1"]]}
    for name, sheets in (("a", one), ("b", two), ("c", three)):
        write_workbook(tmp_path / f"{name}.xlsx", sheets)
    found = workbook.read_cells(spark, str(tmp_path))
    rows, issues, violations = statement.service_fee_rows(found)
    assert sorted((r["order_id"], r["header_set"], r["components"]) for r in rows.collect()) == [("", ["Service Fee", "Campaign"], {"Service Fee": None, "Campaign": None}), ("o1", ["Service Fee", "Campaign"], {"Service Fee": D("-2.50"), "Campaign": None}), ("o3", ["Other"], {"Other": D("1.00")})]
    assert sorted((r["row"], r["code"], r["column"]) for r in issues.collect()) == [(3, "invalid_service_fee_component", "Campaign"), (4, "invalid_service_fee_component", "Campaign"), (4, "invalid_service_fee_component", "Service Fee"), (4, "missing_service_fee_order_id", "Order ID")]
    assert [r["code"] for r in violations.collect()] == ["NO_COMPONENTS"]
    rows, issues, _ = statement.shipping_rows(found)
    assert sorted(((r["order_id"], r["expected"], r["actual"], r["reason"]) for r in rows.collect()), key=str) == [("o1", D("5.00"), D("-6.00"), "weight"), ("o2", None, None, "")]
    assert sorted(r["code"] for r in issues.collect()) == ["invalid_actual_shipping_fee", "invalid_expected_shipping_fee"]
    rows, issues, _ = statement.adjustment_rows(found, "MY")
    assert [(r["sequence_no"], r["amount"], r["payout"]) for r in rows.collect()] == [("1", D("-3.00"), None)]
    assert [r["code"] for r in issues.collect()] == ["invalid_adjustment_payout_date"]
    assert statement.adjustment_rows(found, "SG")[1].count() == 0


# periods and what is committed


def test_period_overlaps_against_all_pairs(spark, monkeypatch):
    r = random.Random(8)
    rows = [(f"p{i}", d := date.fromordinal(730000 + r.randint(0, 400)), date.fromordinal(d.toordinal() + r.choice([0, 0, 6, 30, -1]))) for i in range(120)]
    rows += [("long", date(1990, 1, 1), date(2010, 1, 1)), ("twin", date(1990, 1, 1), date(2010, 1, 1)), ("open", date(1999, 1, 1), None), ("none", None, None)]
    want = set()
    for a, af, at in rows:
        for b, bf, bt in rows:
            if None in (af, at, bf, bt) or af > at or bf > bt or (af, a) >= (bf, b):
                continue
            if bf <= at:
                want.add((a, b, bf, min(at, bt), (min(at, bt) - bf).days + 1, (af, at) == (bf, bt)))
    for bucket in (1, 14, 1000):
        monkeypatch.setattr(overlap, "BUCKET", bucket)
        got = [tuple(x) for x in overlap.period_overlaps(spark.createDataFrame(rows, "id string, period_from date, period_to date")).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_statement_standing(spark):
    row, file = "batch_id string, order_id string, released decimal(18,2)", "batch_id string, file_hash string, period_from date, period_to date"
    committed = spark.createDataFrame([("x", "o1", D(1)), ("x", "o2", None), ("x", "o3", D(3)), ("y", "o3", D(4)), ("x", "", D(1))], row)
    incoming = [("all", "o1", D(1)), ("all", "o2", None), ("off", "o1", D(2)), ("two", "o3", D(3)), ("some", "o1", D(1)), ("some", "o9", D(1)), ("new", "o9", D(1)), ("same", "o9", D(1)), ("blank", "", D(1)), ("both", "o1", D(1)), ("both", "o1", D(2))]
    day = date(2024, 1, 1)
    files = spark.createDataFrame([(b, "h" if b == "same" else b, day, date(2024, 1, 8 if b == "new" else 7)) for b in ("all", "off", "two", "some", "new", "same", "blank", "both", "empty")], file)
    known = spark.createDataFrame([("x", "h", day, date(2024, 1, 7))], file)
    ways = [{r["batch_id"]: r["standing"] for r in overlap.statement_standing(spark.createDataFrame(incoming, row), committed, files, known, ["released"], by_evidence=e).collect()} for e in (True, False)]
    assert ways[0] == {"all": "ALREADY_IMPORTED", "same": "ALREADY_IMPORTED", "off": "SETTLEMENT_EVIDENCE_CONFLICT", "two": "SETTLEMENT_EVIDENCE_CONFLICT", "both": "SETTLEMENT_EVIDENCE_CONFLICT", "some": "PARTIAL_DUPLICATE", "new": "NEW", "blank": "NEW", "empty": "NEW"}
    assert ways[1] == {b: "ALREADY_IMPORTED" if b == "same" else "NEW" if b == "new" else "POSSIBLE_REVISION" for b in ways[0]}


def test_rows_that_hold_their_cells_are_read_where_they_lie(spark):
    """The same as from single cells, but without a shuffle or window of rows; two orders on one row number both stay."""
    sheet = lambda name, *rows: [("p", "h", name, n, c, v, None) for n, values in rows for c, v in enumerate(values) if v is not None]
    fees = sheet("Service Fee Details", (1, ["Sequence No.", "order  ID", "Service Fee"]), (2, ["1", "o1", "RM 2.50"]), (3, ["2", None, "free"]))
    ends = sheet("Adjustment", (1, statement.ADJUSTMENT_KEYS), (2, ["1", "2024-05-01", "Kind", "Why", "-3", "o1", "soon"]), (4, ["TOTAL amount"]), (5, ["2", "2024-05-01", "Kind", "Why", "1", "o2"]))
    found = spark.createDataFrame(fees + ends, "path string, file_hash string, sheet string, row int, col int, value string, error string")
    held = found.groupBy("path", "file_hash", "sheet", "row").agg(F.sort_array(F.collect_list(F.struct("col", "value"))).alias("cells"))
    plain = lambda df: sorted((r.asDict(recursive=True) for r in df.collect()), key=str)
    for read in (statement.service_fee_rows, lambda x: statement.adjustment_rows(x, "MY")):
        assert [plain(x) for x in read(held)] == [plain(x) for x in read(found)] and plain(read(held)[0])
    twice = held.unionByName(held.where("row = 2"))
    rows, issues, _ = statement.service_fee_rows(twice)
    assert rows.where("order_id = 'o1'").count() == 2
    plan = statement.adjustment_rows(statement.stored(held, "held"), "MY")[1]._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan
    parts = statement.components(rows, F.lit("F")).groupBy("name").agg(F.count("amount"))._jdf.queryExecution().optimizedPlan().toString()
    assert "size(map_from_arrays" not in parts
