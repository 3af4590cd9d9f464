"""Room capacity history: as-of lookup and maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hotelspark.operators.stays import as_day


def rooms_as_of(builds: DataFrame, start, end, types: list[str] | DataFrame | None = None) -> DataFrame:
    """(stay_date, room_type_desc, room_count) for every day of the period and every type built by then.

    The count is the one at the latest built_date <= day, the highest where several share that date.
    Entries before the period collapse onto its first day while aggregating, so at most one row per type
    and day is left before the window; no join and no broadcast is involved.
    """
    start, end = as_day(start), as_day(end)
    if isinstance(types, DataFrame):
        builds = builds.join(types.select("room_type_desc").distinct(), "room_type_desc", "left_semi")
    elif types:
        builds = builds.filter(F.col("room_type_desc").isin(types))
    steps = (
        builds.filter((F.col("built_date") <= end) & F.col("room_type_desc").isNotNull())
        .groupBy("room_type_desc", F.greatest(F.col("built_date"), start).alias("valid_from"))
        .agg(F.max(F.struct("built_date", "room_count")).alias("_last"))
    )
    by_type = Window.partitionBy("room_type_desc").orderBy("valid_from")
    until = F.coalesce(F.date_sub(F.lead("valid_from").over(by_type), 1), end)
    return steps.withColumn("valid_to", until).select(
        F.explode(F.sequence("valid_from", "valid_to")).alias("stay_date"), "room_type_desc",
        F.coalesce(F.col("_last.room_count"), F.lit(0)).cast("bigint").alias("room_count"),
    )


def total_rooms_as_of(builds: DataFrame, day, types: list[str] | None = None) -> DataFrame:
    """One row: rooms over all types on a day, 0 when none is built."""
    return rooms_as_of(builds, day, day, types).agg(
        F.coalesce(F.sum("room_count"), F.lit(0)).alias("room_count")
    )


def list_room_builds(builds: DataFrame) -> DataFrame:
    """Capacity history, newest first."""
    return builds.orderBy(F.col("built_date").desc(), F.col("room_build_id").desc())


def upsert_room_builds(builds: DataFrame, changes: DataFrame, key: str = "room_build_id") -> DataFrame:
    """Apply new rows and partial updates: fields left null keep their old value, type names are trimmed.

    An append and a bulk append are the case where no key matches; a change must name at least one field.
    """
    fields = [c for c in builds.columns if c != key]
    named = F.coalesce(*[F.col(c).cast("string") for c in fields]).isNotNull()
    new = changes.filter(named).withColumn("room_type_desc", F.trim("room_type_desc"))
    both = builds.select("*", F.lit(0).alias("_new")).unionByName(new.select(*builds.columns, F.lit(1).alias("_new")))
    return both.groupBy(key).agg(
        *[F.max_by(c, F.struct(F.col(c).isNotNull(), F.col("_new"))).alias(c) for c in fields]
    ).select(*builds.columns)
