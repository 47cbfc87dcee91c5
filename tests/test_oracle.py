"""Every query with SQL gives DuckDB's rows."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from korpora.plans import catalog

DIR = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), sorted(repr([norm(r[i]) for i in order]) for r in rows)


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{DIR}/*.parquet"):
        name = p.rsplit("/", 1)[1].removesuffix(".parquet")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = catalog.queries()[name](spark, DIR)
    cur = duck.execute(catalog.oracle_sql()[name])
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_entry(spark):
    assert entry.entry(spark).columns == ["token", "total", "initial", "mid"]


def test_plain_queries_run(spark):
    for name in set(catalog.queries()) - set(catalog.oracle_sql()):
        catalog.queries()[name](spark, DIR).count()
