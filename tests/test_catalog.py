"""Every example query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from docrecords.plans.catalog import QUERIES, SQL

#: not taken from conftest: a conftest of a test subfolder can stand in its place under that module name
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        table = name.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def plain(rows, columns, wanted):
    at = [columns.index(c) for c in wanted]
    return sorted(tuple("\0" if row[i] is None else str(row[i]) for i in at) for row in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    cursor = db.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = plain(cursor.fetchall(), names, columns)
    got = plain([tuple(r) for r in df.collect()], df.columns, columns)
    assert got == want and got
