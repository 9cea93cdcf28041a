"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from weftgraph.plans import SQL, all_queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, duck, name):
    out = all_queries()[name](spark, FOLDER)
    columns = sorted(out.columns)
    got = sorted(tuple(map(repr, r)) for r in out.select(*columns).collect())
    if name in SQL:
        want = duck.sql(SQL[name])
        at = [want.columns.index(c) for c in columns]
        assert sorted(want.columns) == columns
        assert got == sorted(tuple(repr(r[i]) for i in at) for r in want.fetchall())
