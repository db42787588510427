"""Every query with SQL gives the same rows in DuckDB; the rest give rows."""

import glob
import os

import duckdb
import pytest

from psephos.plans import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("null" if r[i] is None or r[i] != r[i] else repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, sf_dir, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in got.collect()]
    if name not in catalog.ORACLES:
        assert rows
        return
    want = con.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got.columns, rows) == canonical(want.columns, want.fetchall())


def test_entry_and_guard():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
