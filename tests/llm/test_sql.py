"""Queries that SQL can express, against DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from hotelspark.llm.queries import ORACLES, QUERIES
from tests.conftest import SF_DIR


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF_DIR}/{table}.parquet')")
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    want = sorted(cursor.fetchall())
    found = QUERIES[name](spark, SF_DIR)
    assert found.columns == columns
    assert sorted(map(tuple, found.collect())) == want
