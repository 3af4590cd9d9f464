"""Every registered query against its SQL in DuckDB."""

from __future__ import annotations

import pytest

import __spark_entry__ as driver
from hotelspark.workload import ORACLES, QUERIES
from tests.conftest import SF_DIR
from tests.oracle import compare, duck


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    problem = compare(spark, con, name, SF_DIR)
    assert problem is None, problem


def test_entry_has_rows(spark):
    assert driver.entry(spark).count() > 0
