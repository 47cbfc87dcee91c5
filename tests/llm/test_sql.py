"""Queries of the subpackage with SQL give DuckDB's rows."""

import duckdb
import pytest

from korpora.llm import registry
from tests.test_oracle import rows_of


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, name, sf):
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    df = registry.queries()[name](spark, f"/root/testdata/{sf}")
    cur = c.execute(registry.oracle_sql()[name])
    want = rows_of([x[0] for x in cur.description], cur.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want
