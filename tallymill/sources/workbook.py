"""Spreadsheet workbooks and archives as rows.

A workbook is a ZIP of XML files. Spark lists and reads the files (`binaryFile`, so any store works)
and a task turns each into cells; one file is one row of input, so a folder of them spreads over
the cluster. Cells are taken from the sheet's XML itself, never from its declared dimension, which
writers get wrong. A file's identity is the SHA-256 of its bytes.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CELLS = "path string, file_hash string, sheet string, row int, col int, value string, error string"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def column_number(reference: str) -> int:
    """0 for A1, 26 for AA1."""
    n = 0
    for ch in re.match("[A-Z]*", reference)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def _texts(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def cells(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row from 1, column from 0, text) of every cell with a value."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = [_texts(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = targets[sheet.get(_LINK)]
            with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
                at_row = 0
                for _, node in ElementTree.iterparse(f):
                    if node.tag != f"{_MAIN}row":
                        continue
                    at_row = int(node.get("r") or at_row + 1)
                    at_col = -1
                    for c in node.iter(f"{_MAIN}c"):
                        at_col = column_number(c.get("r")) if c.get("r") else at_col + 1
                        value = c.find(f"{_MAIN}v")
                        text = _texts(c) if c.get("t") == "inlineStr" else None if value is None else shared[int(value.text)] if c.get("t") == "s" else value.text
                        if text:
                            yield sheet.get("name"), at_row, at_col, text
                    node.clear()


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """The cells of all workbooks at a path; a broken one gives one row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "file_hash", "sheet", "row", "col", "value", "error"]
        for batch in batches:
            for p, digest, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    found = [(p, digest, *c, None) for c in cells(content)]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, IndexError) as e:
                    found = [(p, digest, None, None, None, None, f"{type(e).__name__}: {e}")]
                for at in range(0, len(found), 50_000):
                    part = found[at : at + 50_000]
                    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names)

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.sha2("content", 256).alias("file_hash"), "content").mapInArrow(run, CELLS)


def sheet_rows(found: DataFrame, sheet: str, required: list[str], optional: tuple[str, ...] = ()) -> DataFrame:
    """A sheet's rows below its header: path, file_hash, row and one text column per name.

    The header is the first row that holds all required names, whatever their case and spacing.
    Files without such a row give none.
    """
    own = found.where((F.col("sheet") == sheet) & F.col("error").isNull())
    name = F.lower(F.trim(F.regexp_replace("value", r"\s+", " ")))
    wanted = {n.lower(): n for n in [*required, *optional]}
    heads = own.where(name.isin(*(n.lower() for n in required))).groupBy("path", "row").agg(F.countDistinct(name).alias("n")).where(F.col("n") == len(required))
    header = heads.groupBy("path").agg(F.min("row").alias("header_row"))
    below = own.join(header, "path")
    columns = below.where((F.col("row") == F.col("header_row")) & name.isin(*wanted)).select("path", "col", name.alias("name"))
    data = below.where("row > header_row").join(columns, ["path", "col"])
    picked = [F.max(F.when(F.col("name") == low, F.col("value"))).alias(n) for low, n in wanted.items()]
    return data.groupBy("path", "file_hash", "row").agg(*picked)


def rows_before(rows: DataFrame, is_end: Column, order: str = "row") -> DataFrame:
    """The rows of each file before the first that says it is the end."""
    ended = F.max(F.when(is_end, 1).otherwise(0)).over(Window.partitionBy("path").orderBy(order))
    return rows.withColumn("_ended", ended).where("_ended = 0").drop("_ended")


def archive_members(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """path, member, content, outcome of the archives' members with a suffix; broken archives have an outcome only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple[str, str | None, bytes | None, str]] = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for m in z.infolist():
                            if m.filename.lower().endswith(suffix):
                                try:
                                    rows.append((p, m.filename, z.read(m), "OK"))
                                except (zipfile.BadZipFile, RuntimeError) as e:
                                    rows.append((p, m.filename, None, type(e).__name__))
                except zipfile.BadZipFile:
                    rows.append((p, None, None, "NOT_AN_ARCHIVE"))
                for r in rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0]], pa.string()), pa.array([r[1]], pa.string()), pa.array([r[2]], pa.binary()), pa.array([r[3]], pa.string())], ["path", "member", "content", "outcome"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, member string, content binary, outcome string")
