"""Comparison of a query with its DuckDB SQL over one of the driver's folders."""

import os

import pytest

SF = os.environ.get("FATHOM_TEST_SF", "/root/testdata/sf0.001")


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted([tuple("%.6g" % x if isinstance(x, float) else str(x) for x in r) for r in frame.itertuples(index=False, name=None)])


def same(spark, query, sql):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.sql(sql).df(), query(spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
