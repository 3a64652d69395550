"""Every query against its SQL, on whole tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="session")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{small}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


CORE = sorted(entry.catalog.QUERIES)


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, small, name):
    df = entry.catalog.QUERIES[name](spark, small)
    got = [tuple(r) for r in df.collect()]
    sql = entry.catalog.ORACLES.get(name)
    if sql is None:
        assert df.columns and got
        return
    res = duck.execute(sql)
    names = [c[0] for c in res.description]
    want = rows_of(names, res.fetchall())
    assert sorted(df.columns) == sorted(names)
    mine = rows_of(df.columns, got)
    assert len(mine) == len(want)
    for a, b in zip(mine, want):
        assert all(x == y or isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6) for x, y in zip(a, b)), (a, b)


def test_entry(spark):
    assert entry.entry(spark).count() == 10
