"""Every query with SQL against DuckDB on the smallest tables; the others for rows."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_module
from tessera.plans import catalog

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        df[c] = df[c].map(lambda x: None if x is None or x is pd.NA or isinstance(x, float) and x != x else f"{x:.6f}" if isinstance(x, float) else str(x))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, D).toPandas()
    want = duck.execute(catalog.ORACLE_SQL[name]).df() if name in catalog.ORACLE_SQL else None
    assert len(got.columns)
    if want is not None:
        pd.testing.assert_frame_equal(plain(got), plain(want))


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
