"""Every registered query against its SQL twin on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract

SF_DIR = contract.SMOKE_DIR
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def cell(value):
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return str(value) if hasattr(value, "isoformat") else value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = [tuple(cell(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(body, key=repr)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = contract.queries()[name](spark, SF_DIR)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    found = duck.execute(contract.oracle_sql()[name])
    want = table([c[0] for c in found.description], found.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0
