"""Every query against the SQL that must give its rows, both over the smallest tables."""

from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from lexloom.plans import all_queries

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no sample tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def cell(value):
    if value is None or value is pd.NaT or value is pd.NA or (np.isscalar(value) and pd.isna(value)):
        return "null"
    if isinstance(value, (float, np.floating)):
        return f"{value:.6g}"
    if isinstance(value, (bool, np.bool_, int, np.integer)):
        return str(int(value))
    if type(value).__name__ in ("Timestamp", "date", "datetime", "datetime64"):
        return str(pd.Timestamp(value))
    return str(value)


def rows(df):
    return sorted(tuple(cell(v) for v in row) for row in df[sorted(df.columns)].values.tolist())


@pytest.mark.parametrize("name", all_queries.QUERIES)
def test_query(spark, duck, name):
    got = all_queries.QUERIES[name](spark, str(DATA)).toPandas()
    if name not in all_queries.ORACLES:
        assert len(got)
        return
    want = duck.sql(all_queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
