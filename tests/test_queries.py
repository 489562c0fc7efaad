"""Every registered query of the settlement engine against its SQL."""

import math

import duckdb
import pytest

from tallymill import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(value, 6) if isinstance(value, float) else int(value) if isinstance(value, int) and not isinstance(value, bool) else str(value)


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=str)


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query_equals_its_sql(spark, oracle, name):
    df = registry.queries()[name](spark, FOLDER)
    expected = oracle.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows(df.columns, df.collect()) == rows(expected.columns, expected.fetchall())


def test_entry_runs_without_the_optional_subpackage(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(registry.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_percentiles_window_over_distinct_amounts(spark, monkeypatch):
    from decimal import Decimal

    from tallymill.plans import queries

    amounts = {"few": [None, 3, 1, 2, 2], "one": [7], "none": [None], "many": [i % 10 for i in range(1000)]}
    made = spark.createDataFrame([(k, None if x is None else Decimal(x)) for k, xs in amounts.items() for x in xs], "kind string, amount decimal(18,2)")
    monkeypatch.setattr(queries.c, "adjustments", lambda *_: made)
    df = queries.event_percentiles(spark, FOLDER)
    got = {r["kind"]: (r["n_events"], r["median"], r["p95"], r["amount"]) for r in df.collect()}
    assert got == {"few": (5, 2.0, 3.0, 8.0), "one": (1, 7.0, 7.0, 7.0), "none": (1, None, None, None), "many": (1000, 4.0, 9.0, 4500.0)}
    below = df._jdf.queryExecution().optimizedPlan().toString().split("Window [")[-1]
    assert "Aggregate [kind" in below


def test_bundles_are_read_from_their_stored_ledger(spark):
    """Neither the items again nor a shuffle, whoever uses rows and verdicts."""
    from tallymill.operators import changes
    from tallymill.plans import billing

    made, verdicts = billing._bundle_verdicts(spark, FOLDER)
    for df in (made, verdicts, changes.write_plan(made, verdicts, "order_id")):
        assert df.inputFiles() and not any("lineitem" in f for f in df.inputFiles())
        assert "hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()
