"""The operators that SQL can express against that SQL, over the smallest tables."""

from pathlib import Path

import pytest

from lexloom.llm.queries import ORACLES, QUERIES
from tests.test_oracles import rows

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no sample tables")
@pytest.mark.parametrize("name", ORACLES)
def test_operator(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    got, want = QUERIES[name](spark, str(DATA)).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.skipif(not DATA.exists(), reason="no sample tables")
@pytest.mark.parametrize(("name", "label", "modulus", "out"), [("op1_toxicity", "toxic", 5, 0), ("op4_quality", "quality", 3, 1)])
def test_held_out_rows_are_told_apart(spark, name, label, modulus, out):
    """Area under the curve on rows whose labels were not read."""
    import zlib

    import pandas as pd

    large = DATA.parent / "sf0.01"
    got = QUERIES[name](spark, str(large)).toPandas()
    assert all(got.held_out == [zlib.crc32(str(i).encode()) % modulus == out for i in got.doc_id])
    both = got[got.held_out].merge(pd.read_parquet(large / "labels.parquet"), on="doc_id")
    rank, y = both.score.rank(), both[label] == 1
    area = (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert area > 0.85


@pytest.mark.skipif(not DATA.exists(), reason="no sample tables")
def test_languages_of_held_out_rows(spark):
    import pandas as pd

    large = DATA.parent / "sf0.01"
    got = QUERIES["op3_language"](spark, str(large)).toPandas().merge(pd.read_parquet(large / "documents.parquet"), on="doc_id")
    own = got[got.held_out]
    assert (own.lang == own.lang_pred).mean() > 0.97
