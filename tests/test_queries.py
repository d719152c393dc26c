"""Every query of the catalog against its SQL in DuckDB, where it has one."""

import os

import duckdb
import pytest

from quillspark.plans import build, catalog, curation, library  # noqa: F401

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    got = catalog.queries()[name](spark, SF)
    if name not in catalog.oracle_sql():  # tests of their own are in test_build.py
        assert got.columns and got.count() > 0
        return
    rows = sorted(map(repr, (tuple(r[c] for c in sorted(got.columns)) for r in got.collect())))
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    want = db.sql(catalog.oracle_sql()[name])
    at = sorted(range(len(want.columns)), key=lambda i: want.columns[i])
    assert [want.columns[i] for i in at] == sorted(got.columns)
    assert rows == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
