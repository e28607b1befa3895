"""Every registered query of the library against its SQL on the smallest tables; those without SQL give rows with a stable schema."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from demandlens.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(SF, name)}.parquet'")
    return con


def text(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
        return "NULL"
    return repr(round(float(v), 9)) if isinstance(v, (float, np.floating)) else str(v)


def shown(df):
    df = df[sorted(df.columns)]
    df = pd.DataFrame({c: df[c].map(text) for c in df})
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    own, other = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(own.columns) == sorted(other.columns)
    for c in own:
        if own[c].dtype.kind in "if" and other[c].dtype.kind in "if":
            own[c], other[c] = own[c].astype(float), other[c].astype(float)
    pd.testing.assert_frame_equal(shown(own), shown(other))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, name):
    first, again = QUERIES[name](spark, SF), QUERIES[name](spark, SF)
    assert first.schema == again.schema and first.count() > 0
