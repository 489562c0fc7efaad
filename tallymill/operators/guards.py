"""Invariants as frames of violations, with one place that raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class InvariantError(ValueError):
    """A relation broke an invariant; nothing may be published."""


def orphans(rows: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose parent is missing."""
    return rows.join(parents.select(keys).distinct(), keys, "left_anti")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are not unique, with how often they occur."""
    return rows.groupBy(keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def foreign_rows(rows: DataFrame, column: str, allowed: str) -> DataFrame:
    """Rows of another market."""
    return rows.where(~F.col(column).eqNullSafe(F.lit(allowed)))


def off_cent(rows: DataFrame, column: Column) -> DataFrame:
    """Rows whose amount is no whole number of cents."""
    return rows.where(column != column.cast("decimal(18,2)"))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one side has, repeated rows counted, with the side."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def require_none(**violations: DataFrame) -> None:
    """Raises if any of the frames has a row, naming the first of each."""
    found = {name: rows.limit(5).collect() for name, rows in violations.items()}
    if bad := {name: rows for name, rows in found.items() if rows}:
        raise InvariantError("; ".join(f"{name}: {', '.join(str(r.asDict()) for r in rows)}" for name, rows in bad.items()))
