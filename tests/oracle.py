"""Runs a query and its SQL on the same tables and compares all rows."""

import os

import pytest

DATA = os.environ.get("LOCIWEAVE_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(pdf):
    names = sorted(pdf.columns)
    return names, sorted(map(tuple, pdf[names].astype(object).where(pdf[names].notna(), None).values.tolist()), key=str)


def compare(spark, query, sql):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = rows_of(query(spark, DATA).toPandas()), rows_of(con.execute(sql).df())
    assert got[0] == want[0]
    assert got[1] == want[1]
    assert got[1]


def runs(spark, query):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    assert query(spark, DATA).count() > 0
