"""Every registered query with SQL against DuckDB, at the smallest scale."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return None
        if type(v).__name__ in ("bool", "bool_"):
            return str(bool(v))
        return round(float(v), 5) if hasattr(v, "__float__") and not isinstance(v, (str, bool)) else str(v)

    return sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query_equals_sql(spark, sf, db, name):
    got = entry.queries()[name](spark, sf).toPandas()
    want = db.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_operator_has_a_query():
    from millrace.operators import OPERATORS
    from millrace.operators.queries import SPECS

    assert all(any(f"{op}(" in spec[2] for spec in SPECS.values()) for op in OPERATORS)
