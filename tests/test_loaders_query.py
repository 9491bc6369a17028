"""The loaders' query writes its files into a shared folder that is there before anything is written, and agrees with its SQL."""

import os

import pytest

from streamcontract import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_loaders_agree_with_sql(spark, tmp_path, monkeypatch):
    import duckdb

    (tmp_path / "other").mkdir()
    monkeypatch.setattr(Q, "_scratch", lambda _: f"file://{tmp_path}")
    got = {tuple(r) for r in Q.QUERIES["src_7_loaders"](spark, SF).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW nation AS SELECT * FROM '{SF}/nation.parquet'")
    want = set(con.execute(Q.SQL["src_7_loaders"]).fetchall())
    assert len(got) == 25 and got == want
