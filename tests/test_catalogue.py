"""Every registered query runs, and its SQL agrees, on the smallest tables if these are at hand."""

from __future__ import annotations

import os

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
def _names():
    from foliomill import catalogue

    return sorted(catalogue.queries())


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", _names())
def test_query(spark, duck, name):
    from foliomill import catalogue

    out = catalogue.queries()[name](spark, SF)
    rows = sorted(repr(tuple(r[c] for c in sorted(out.columns))) for r in out.collect())
    sql = catalogue.oracle_sql().get(name)
    if sql:
        found = duck.execute(sql)
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(out.columns)
        order = [columns.index(c) for c in sorted(columns)]
        assert rows == sorted(repr(tuple(r[i] for i in order)) for r in found.fetchall())


def test_entry_module_runs(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
