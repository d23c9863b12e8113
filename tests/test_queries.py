import os

import duckdb
import pytest

import __spark_entry__ as entry
from chirplake import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for name in os.listdir(SF):
        c.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{SF}/{name}')")
    return c


def plain(v):
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", queries.QUERIES)
def test_same_as_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name not in queries.SQL:
        assert got
        return
    result = db.execute(queries.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
