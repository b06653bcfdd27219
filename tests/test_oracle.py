"""Every catalogue query with a SQL twin agrees with DuckDB on the sf0.001 tables;
the rest run and return their schema."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from salesspark.sources.tables import TABLE_NAMES

SF = "/root/testdata/sf0.001"
SQL = E.oracle_sql()
ALL = E.queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLE_NAMES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return round(float(v), 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return cols, sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", [n for n in sorted(SQL) if not n.startswith("op")])
def test_query_matches_sql_twin(spark, con, name):
    got = _rows(ALL[name](spark, SF).toPandas())
    want = _rows(con.execute(SQL[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]


NO_TWIN = sorted(set(ALL) - set(SQL))


def test_every_query_has_a_sql_twin():
    assert not [n for n in NO_TWIN if not n.startswith("op") and n != "pipeline"]


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["Region", "Net_Revenue", "Profit", "Orders", "Units"]
    assert len(rows) == 5
