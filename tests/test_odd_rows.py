"""Rows that large tables have and small ones lack, held against the SQL."""

import datetime as dt

import pytest

from quantloom.plans import catalog
from quantloom.sources import bindings

duckdb = pytest.importorskip("duckdb")


def against_sql(spark, folder, name, tables):
    """Sorted rows of query and oracle over tables that are written to `folder`."""
    con = duckdb.connect()
    for table, rows in tables.items():
        path = f"{folder}/{table}.parquet"
        spark.createDataFrame(rows, bindings.SCHEMAS[table]).coalesce(1).write.parquet(path)
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    return [sorted(map(tuple, rows), key=str) for rows in (catalog.queries()[name](spark, str(folder)).collect(), con.execute(catalog.oracle_sql()[name]).fetchall())]


def statements(years):
    """Orders and their lines from (customer, year, price, discount, tax); discount .10 with tax .05 makes a cash flow of zero."""
    days = [y and dt.datetime(y, 5, 1) for _, y, *_ in years]
    orders = [(i, c, "O", 1.0, day, "x") for i, ((c, *_), day) in enumerate(zip(years, days))]
    lines = [(i, 1, 1, 1, 5.0, p, d, t, "N", "O", day) for i, ((_, _, p, d, t), day) in enumerate(zip(years, days))]
    return {"orders": orders, "lineitem": lines}


# growth is unknown for 1 (zero first), 3 (zero twice) and 5 (no price in the first year)
YEARS = [
    (1, 1995, 1000.0, 0.10, 0.05), (1, 1996, 1000.0, 0.02, 0.03), (2, 1995, 1000.0, 0.02, 0.01), (2, 1996, 1500.0, 0.03, 0.02),
    (3, 1995, 1000.0, 0.10, 0.05), (3, 1996, 2000.0, 0.10, 0.05), (3, 1997, 3000.0, 0.01, 0.01), (4, 1995, 800.0, 0.01, 0.01),
    (5, 1995, None, 0.10, 0.05), (5, 1996, 100.0, 0.01, 0.01),
]


def test_value_without_a_known_growth_is_unknown(spark, tmp_path):
    got, expected = against_sql(spark, tmp_path, "dcf_b", statements(YEARS))
    assert got == expected
    assert [r[0] for r in got if r[3] is None and r[4] is None] == ["C1", "C3", "C5"] and len(got) == 5


def test_flows_without_a_known_growth_are_unknown(spark, tmp_path):
    got, expected = against_sql(spark, tmp_path, "dcf_b_flows", statements(YEARS))
    assert got == expected
    assert [r[:2] for r in got if r[2] is None] == [(c, y) for c in ("C1", "C3", "C5") for y in range(1, 6)] and len(got) == 25


@pytest.mark.parametrize("name", ["dcf_b", "dcf_b_flows"])
def test_last_known_cash_flow_counts(spark, tmp_path, name):
    line = lambda c, y, p: (c, y, p, 0.02, 0.01)
    got, expected = against_sql(spark, tmp_path, name, statements([
        line(1, 1995, 1000.0), line(1, 1996, 1500.0), line(1, 1997, None),  # no price in the last year
        line(2, 1995, 1000.0), line(2, 1996, 1500.0), line(2, None, 800.0),  # no date
        line(3, None, 800.0),
    ]))
    assert got == expected and {r[0] for r in got if r[2] is not None} == {"C1", "C2"}
