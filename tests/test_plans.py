"""What the plans of the registered queries may not contain."""

from __future__ import annotations

import tempfile

import pytest

from hotelspark.workload import QUERIES
from tests.conftest import SF_DIR

# Runs jobs while it is built (component rounds), so it is planned once in the comparison tests instead.
BUILDS_WITH_JOBS = {"bills_merged", "bills_consolidated"}


def plan_of(spark, name):
    return QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - BUILDS_WITH_JOBS))
def test_no_nested_loops_python_or_broadcast_hints(spark, name):
    plan = plan_of(spark, name)
    for word in ("NestedLoopJoin", "CartesianProduct", "PythonUDF", "ArrowEval", "BatchEval", "MapInPandas"):
        assert word not in plan


def test_period_and_columns_reach_the_scan(spark):
    from hotelspark.plans.report import occupancy_report

    path = tempfile.mkdtemp(prefix="hotelspark-test-") + "/stays"
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    rows = QUERIES["mart_reservations"](spark, SF_DIR)
    rows = rows.withColumns({c: rows[c].cast("date") for c in ("arrival_date", "depart_date")})
    rows.write.parquet(path)
    builds = spark.createDataFrame([], "room_build_id int, built_date date, room_count int, room_type_desc string")
    report = occupancy_report(spark.read.parquet(path), builds, "1998-03-01", "1998-03-31", "segment", {"nationality": "NATION_1"})
    scans = [x for x in report._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan parquet" in x]
    assert scans
    for scan in scans:
        assert "LessThanOrEqual(arrival_date,1998-03-31)" in scan and "GreaterThanOrEqual(depart_date,1998-03-01)" in scan
        assert "EqualTo(nationality,NATION_1)" in scan or "In(nationality" in scan
        assert "email" not in scan.split("ReadSchema")[1]
