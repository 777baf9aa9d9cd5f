"""Queries with SQL against it, over the smallest tables."""

import duckdb
import pytest

from codonframe.llm import registry
from tests.test_catalog import DATA, TABLES, ordered


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    expected = con.sql(registry.oracle_sql()[name])
    found = registry.queries()[name](spark, DATA)
    assert sorted(found.columns) == sorted(expected.columns)
    assert ordered(found.columns, found.collect()) == ordered(expected.columns, expected.fetchall())
