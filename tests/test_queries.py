"""Every query with SQL agrees with it on the smallest tables."""

import os

import pandas as pd
import pytest

from streamcontract import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def cell(x):
    if hasattr(x, "__len__") and not isinstance(x, str):
        return str(list(x))
    if pd.isna(x):
        return "null"
    return str(x)


def rows(pdf):
    return sorted(tuple(map(cell, r)) for r in pdf[sorted(pdf.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, con, name):
    got = Q.QUERIES[name](spark, SF).toPandas()
    if name in Q.SQL:
        want = con.execute(Q.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)
