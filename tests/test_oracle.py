"""Every query with a SQL twin matches DuckDB exactly at sf0.001."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from stayrisk import plans

SF = "/root/testdata/sf0.001"
NAMES = sorted(plans.ORACLE)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("orders", "customer", "lineitem", "nation", "region", "part", "supplier"):
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return c


def _norm(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: None if v is None or (isinstance(v, float) and v != v)
                          else (v.item() if hasattr(v, "item") else v)).astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_duckdb(spark, con, name):
    a = E.queries()[name](spark, SF).toPandas()
    b = con.sql(E.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert len(a) == len(b)
    pd.testing.assert_frame_equal(_norm(a), _norm(b))


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "cancel_probability" in df.columns
