"""The registered queries of the settlement engine, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallymill.plans import billing, checks, oracle, reporting, statements
from tallymill.plans.queries import QUERIES

FLAGSHIP = "order_settlement_report"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracle.SQL | reporting.SQL | billing.SQL | checks.SQL | statements.SQL
