"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from papyrine.plans import catalogue

D = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(D):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{D}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, D)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    if name in SQL:
        r = duck.sql(SQL[name])
        at = [r.columns.index(c) for c in cols]
        assert sorted(r.columns) == cols
        assert sorted((tuple(x[i] for i in at) for x in r.fetchall()), key=repr) == got
