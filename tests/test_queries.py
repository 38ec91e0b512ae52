"""Every query with SQL against DuckDB on the same tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tallyline.plans import queries as ledger

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ledger.QUERIES))
def test_same_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    rel = duck.sql(entry.oracle_sql()[name])
    want = table(rel.columns, rel.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
