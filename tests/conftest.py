from __future__ import annotations

import os

import pytest
from pyspark.sql import SparkSession

SF_DIR = os.environ.get("HOTELSPARK_SF_DIR", "/root/testdata/sf0.001")


def make_session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]").appName("hotelspark-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "Asia/Jakarta")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def spark():
    session = make_session()
    yield session
    session.stop()
