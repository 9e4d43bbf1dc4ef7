import os

import pytest

import __spark_entry__ as entry
from rillwork.plans import catalogue

HERE = catalogue.queries()


@pytest.fixture(scope="module")
def duck(sf):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        p = f"{sf}/{name}.parquet"
        c.sql(f"create view {name} as select * from '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else f"{v:.9g}" if v else "0"
    return None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(HERE))
def test_query(name, spark, sf, duck):
    df = HERE[name](spark, sf)
    rows = df.collect()
    sql = catalogue.oracle_sql().get(name)
    assert len(set(df.columns)) == len(df.columns)
    if sql is None:
        assert rows
        return
    want = duck.sql(sql)
    assert sorted(want.columns) == sorted(df.columns)
    columns = sorted(df.columns)
    at = [want.columns.index(c) for c in columns]
    a = sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=str)
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)
    assert a == b


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
