"""Registration and the common result types (text for days and times, bigint, double)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hotelspark import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Days and times as text, integers as bigint, decimals as double, so both engines return equal values."""
    def plain(name: str, kind: str):
        c = F.col(f"`{name}`")
        if kind.startswith(("date", "timestamp")):
            return c.cast("string").alias(name)
        if kind in ("int", "smallint", "tinyint"):
            return c.cast("bigint").alias(name)
        if kind.startswith("decimal") or kind == "float":
            return c.cast("double").alias(name)
        return c
    return df.select(*[plain(n, k) for n, k in df.dtypes])


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(n, digits).alias(n) if k == "double" else F.col(n) for n, k in df.dtypes])


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register ``build(load)``; ``load`` returns a driver table or fixture view by name.

    ``views`` are put before the oracle as WITH members; the oracle continues that list or starts its SELECT.
    """
    def register(build: Callable):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            def load(source: str) -> DataFrame:
                read = fixtures.view if source in fixtures.VIEWS else fixtures.table
                return read(spark, sf_dir, source)
            return tidy(build(load))
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = f"WITH {fixtures.ctes(*views)}\n{sql}" if views else sql
        return build
    return register
