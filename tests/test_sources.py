"""Workbooks and archives built here, and versions that are published."""

import zipfile

import pytest
from pyspark.sql import functions as F

from tallymill.operators.guards import InvariantError
from tallymill.sources import published, workbook

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def write_workbook(path, rows):
    cell = lambda r, c, v: f'<c r="{chr(65 + c)}{r}" t="s"><v>{v[1:]}</v></c>' if v.startswith("$") else f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>'
    sheet = "".join(f'<row r="{n}">{"".join(cell(n, c, v) for c, v in enumerate(r) if v)}</row>' for n, r in enumerate(rows, 1))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Income" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}><si><t>Order</t></si></sst>")
        z.writestr("xl/worksheets/s.xml", f'<worksheet {MAIN}><dimension ref="A1"/><sheetData>{sheet}</sheetData></worksheet>')


def test_workbook_rows_below_a_header_found_anywhere(spark, tmp_path):
    write_workbook(tmp_path / "a.xlsx", [["note"], ["View  by", "Order ID", "Amount"], ["$0", "0012", "5.00"], ["Sku", "", "1.00"], ["Total Amount"], ["after", "9"]])
    (tmp_path / "b.xlsx").write_bytes(b"no archive")
    found = workbook.read_cells(spark, str(tmp_path))
    assert [r["error"].split(":")[0] for r in found.where("error IS NOT NULL").collect()] == ["BadZipFile"]
    rows = workbook.sheet_rows(found, "Income", ["View By", "Order ID"], ("Amount", "Missing"))
    rows = workbook.rows_before(rows, F.lower("View By") == "total amount")
    got = [(r["row"], r["View By"], r["Order ID"], r["Amount"], r["Missing"]) for r in rows.orderBy("row").collect()]
    assert got == [(3, "Order", "0012", "5.00", None), (4, "Sku", None, "1.00", None)]
    assert workbook.column_number("AB7") == 27


def test_archive_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.pdf", "one")
        z.writestr("y.txt", "two")
    (tmp_path / "b.zip").write_bytes(b"broken")
    got = sorted((r["member"] or "", r["outcome"]) for r in workbook.archive_members(spark, str(tmp_path), ".pdf").collect())
    assert got == [("", "NOT_AN_ARCHIVE"), ("x.pdf", "OK")]


def test_a_version_is_published_only_when_nothing_is_violated(spark, tmp_path):
    folder = (tmp_path / "facts").as_uri()
    assert published.current(spark, folder) is None
    one, two = spark.createDataFrame([("a", 1)], "k string, v int"), spark.createDataFrame([("a", 2), ("b", None)], "k string, v int")
    published.publish(one, folder, 1)
    with pytest.raises(InvariantError):
        published.publish(two, folder, 2, bad=two.where("k = 'b'"))
    assert [tuple(r) for r in published.current(spark, folder).collect()] == [("a", 1)]
    published.publish(two, folder, 3)
    assert published.current(spark, folder).count() == 2
    with pytest.raises(FileExistsError):  # not even from itself: it would be gone before it is read
        published.publish(published.current(spark, folder), folder, 3)
    assert published.current(spark, folder).count() == 2
    assert published.digest(two, ["k"]).first().asDict() == published.digest(two.orderBy("v"), ["k"]).first().asDict()
    assert published.digest(two, ["k"]).first()["row_xor"] != published.digest(one, ["k"]).first()["row_xor"]


def test_a_set_of_relations_is_committed_whole(spark, tmp_path):
    folder = (tmp_path / "set").as_uri()
    assert published.manifest(spark, folder) is None and published.read_set(spark, folder) == {} and published.unverified(spark, folder) == []
    orders, lines = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int"), spark.createDataFrame([], "k string, w double")
    first = published.commit_set({"orders": orders, "lines": lines}, folder, "batch 1", None)
    assert first["version"] == 1
    assert {name: sorted(map(tuple, df.collect()), key=str) for name, df in published.read_set(spark, folder).items()} == {"orders": [("a", 1), (None, 2)], "lines": []}
    broken = spark.createDataFrame([("b", 3.0)], "k string, w double").withColumn("w", F.raise_error(F.lit("no")).cast("double"))
    newer = spark.createDataFrame([("b", 9)], "k string, v int")
    with pytest.raises(Exception, match="no"):  # between the two relations
        published.commit_set({"orders": newer, "lines": broken}, folder, "batch 2", 1)
    assert published.manifest(spark, folder) == first and published.read_set(spark, folder)["orders"].count() == 2
    assert len(list((tmp_path / "set" / "data").iterdir())) == 1  # nothing is left of it
    with pytest.raises(InvariantError):
        published.commit_set({"orders": newer}, folder, "batch 2", 1, lambda made: {"too_large": made["orders"].where("v > 5")})
    second = published.commit_set({"orders": newer}, folder, "batch 2", 1)
    assert second["version"] == 2 and second["relations"]["lines"] == first["relations"]["lines"]
    assert published.read_set(spark, folder)["orders"].collect()[0]["v"] == 9
    assert published.commit_set({"orders": orders}, folder, "batch 1", 2) == first  # a replay
    with pytest.raises(published.StaleBaseline):
        published.commit_set({"orders": orders}, folder, "batch 3", 1)
    with pytest.raises(published.StaleBaseline):  # another commit gets there between reading and naming
        published._Folder(spark, folder).write_manifest(2, {})
    assert published.unverified(spark, folder) == []


def test_what_is_written_is_computed_once(spark, tmp_path):
    """Rows that differ each time they are computed."""
    folder = (tmp_path / "set").as_uri()
    published.commit_set({"r": spark.range(50).withColumn("x", F.rand())}, folder, "b", None)
    assert published.unverified(spark, folder) == []
    path = published.manifest(spark, folder)["relations"]["r"]
    spark.range(3).withColumn("x", F.rand()).write.mode("append").parquet(path)
    assert published.unverified(spark, folder) == ["r"]


def test_a_manifest_that_is_being_written_is_not_there_yet(spark, tmp_path):
    folder = (tmp_path / "set").as_uri()
    made = published.commit_set({"r": spark.range(2)}, folder, "b", None)
    (tmp_path / "set" / "manifests" / "000000000002.json").write_text('{"version": 2, "rel')
    assert published.manifest(spark, folder) == made and published.read_set(spark, folder)["r"].count() == 2
