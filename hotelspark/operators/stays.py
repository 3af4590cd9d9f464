"""Stays: period filters, day expansion and room-night aggregates."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotelspark.functions.hotel import age_group

DIMENSIONS = ("segment", "room_type_desc", "local_region", "nationality")


def as_day(value: date | str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")


def split_list(value: str | list[str] | None) -> list[str]:
    """Comma list -> trimmed, non-empty items."""
    items = value.split(",") if isinstance(value, str) else (value or [])
    return [v.strip() for v in items if v and v.strip()]


def overlap_filter(df: DataFrame, start, end, inclusive: bool = True, arrival="arrival_date", depart="depart_date"):
    """Stays touching the period; ``inclusive`` counts stays that only meet its first or last day.

    Works on the stored columns (dates or timestamps) so the bounds reach the file scan.
    """
    a, d, s, e = F.col(arrival), F.col(depart), as_day(start), as_day(end)
    return df.filter((a <= e) & (d >= s)) if inclusive else df.filter((a < e) & (d > s))


def dimension_filters(df: DataFrame, in_: Mapping | None = None, not_in: Mapping | None = None) -> DataFrame:
    """Conjunctive IN / NOT IN lists per column; an empty list filters nothing."""
    for column, values in (in_ or {}).items():
        if items := split_list(values):
            df = df.filter(F.col(column).isin(items))
    for column, values in (not_in or {}).items():
        if items := split_list(values):
            df = df.filter(~F.col(column).isin(items))
    return df


def active_stays(df: DataFrame, day) -> DataFrame:
    """Guests in house: arrival <= day < depart."""
    return df.filter((F.col("arrival_date") <= as_day(day)) & (F.col("depart_date") > as_day(day)))


def group_key(group_by: str) -> Column:
    """Breakdown key of a grouping; null dimension values become 'Unknown'."""
    if group_by == "none":
        return F.lit(None).cast("string")
    if group_by == "age_group":
        return age_group(F.col("age"))
    if group_by in DIMENSIONS:
        return F.coalesce(F.col(group_by), F.lit("Unknown"))
    raise ValueError(f"unknown grouping: {group_by}")


def clip_stays(df: DataFrame, start, end) -> DataFrame:
    """Overlapping stays with ``first_day`` and ``last_day`` inside the period, still one row per stay."""
    start, end = as_day(start), as_day(end)
    return overlap_filter(df, start, end).withColumns({
        "first_day": F.greatest(F.col("arrival_date").cast("date"), start),
        "last_day": F.least(F.col("depart_date").cast("date"), end),
    }).filter(F.col("first_day") <= F.col("last_day"))


def expand_stays(df: DataFrame, start, end) -> DataFrame:
    """One row per stay and day of the period, the departure day included."""
    return (
        clip_stays(df, start, end)
        .withColumn("stay_date", F.explode(F.sequence("first_day", "last_day")))
        .drop("first_day", "last_day")
    )


def spans(df: DataFrame, start, end, *keys: Column) -> DataFrame:
    """Stays summed per key and clipped span.

    All room-night measures follow from (first_day, last_day, number of stays, sum of rates), so the
    data shrinks before anything is shuffled and days are only expanded afterwards, over a set bounded
    by the square of the period length.
    """
    return (
        clip_stays(df, start, end)
        .groupBy(*keys, "first_day", "last_day")
        .agg(F.sum("room_rate").alias("rates"), F.count("room_rate").alias("rated"), F.count(F.lit(1)).alias("stays"))
        .withColumn("days", F.datediff("last_day", "first_day") + 1)
    )


def room_night_aggregate(df: DataFrame, start, end, group_by: str = "none", filters: Mapping | None = None) -> DataFrame:
    """Room nights per group and in total: revenue_sum, room_sold, arr_simple, bookings_count, period_days.

    Columns: is_total, key, measures. The total row is told by ``is_total``, never by a null key, and is
    present (with zeros) even when nothing matches. Blank keys count in the total but get no row.
    """
    stays = clip_stays(dimension_filters(df, filters).withColumn("key", group_key(group_by)), start, end)
    days = F.datediff("last_day", "first_day") + 1
    measured = stays.select(
        "key", "reservation_id", (F.col("room_rate") * days).alias("revenue"), F.when(F.col("room_rate").isNotNull(), days).alias("rated"), days.alias("sold"))
    # One row that adds nothing lets the total appear even when nothing matches.
    nothing = df.sparkSession.range(1).select(*[F.lit(None).cast(t).alias(c) for c, t in measured.dtypes])
    sums = [F.sum(c).alias(c) for c in ("revenue", "rated", "sold")] + [F.countDistinct("reservation_id").alias("bookings")]
    rows = measured.unionByName(nothing)
    if group_by == "none":
        rows = rows.agg(*sums).select(F.lit(True).alias("is_total"), F.lit(None).cast("string").alias("key"), "*")
    else:
        # Groups and total come out of one pass over the stays.
        rows = rows.groupingSets([["key"], []], "key").agg(F.grouping("key").alias("all"), *sums)
        rows = rows.withColumn("is_total", F.col("all") == 1).filter((F.col("all") == 1) | (F.trim("key") != ""))
    return rows.select(
        "is_total", "key",
        F.coalesce(F.col("revenue").cast("double"), F.lit(0.0)).alias("revenue_sum"),
        F.coalesce("sold", F.lit(0)).cast("bigint").alias("room_sold"),
        F.coalesce(F.col("revenue").cast("double") / F.nullif("rated", F.lit(0)), F.lit(0.0)).alias("arr_simple"),
        F.coalesce("bookings", F.lit(0)).cast("bigint").alias("bookings_count"),
        (F.datediff(as_day(end), as_day(start)) + 1).cast("bigint").alias("period_days"),
    )


def nightly_by_type(df: DataFrame, start, end, filters: Mapping | None = None) -> DataFrame:
    """revenue_sum and room_sold per day and room type; rows without a type fall out."""
    stays = dimension_filters(df, filters).filter(F.col("room_type_desc").isNotNull())
    return nights_of_spans(spans(stays, start, end, F.col("room_type_desc")), "room_type_desc")


def nights_of_spans(span_rows: DataFrame, *keys: str) -> DataFrame:
    """Expand summed spans to days: exact decimal revenue and rooms sold per day and key."""
    return (
        span_rows.withColumn("stay_date", F.explode(F.sequence("first_day", "last_day")))
        .groupBy("stay_date", *keys)
        .agg(F.sum("rates").alias("revenue_sum"), F.sum("stays").alias("room_sold"))
    )


def overlap_nights_aggregate(df: DataFrame, start, end, group_by: str = "none", filters: Mapping | None = None,
                             clipped: bool = True) -> DataFrame:
    """Pro-rata nights: per group revenue_sum = sum(rate x nights in period), occupied_room_nights, mean rate, stays.

    The period bounds are exclusive. ``clipped=False`` counts whole stays (rate x nights). Blank and
    missing keys are both 'Unknown'; the total row has ``is_total`` set.
    """
    stays = dimension_filters(overlap_filter(df, start, end, inclusive=False), filters)
    arrive, depart = F.col("arrival_date").cast("date"), F.col("depart_date").cast("date")
    inside = F.datediff(F.least(depart, as_day(end)), F.greatest(arrive, as_day(start)))
    nights = F.greatest(F.lit(0), F.least(inside, F.col("nights"))) if clipped else F.col("nights")
    key = group_key(group_by) if group_by in ("none", "age_group") else F.coalesce(
        F.nullif(F.col(group_by), F.lit("")), F.lit("Unknown")
    )
    measured = stays.select(key.alias("key"), F.col("room_rate"), nights.alias("n"))
    sums = measured.groupBy("key").agg(
        F.sum(F.col("room_rate") * F.col("n")).alias("revenue"), F.sum("n").alias("nights"),
        F.sum("room_rate").alias("rates"), F.count("room_rate").alias("rated"), F.count(F.lit(1)).alias("stays"),
    )
    rows = sums.agg(*[F.sum(c).alias(c) for c in ("revenue", "nights", "rates", "rated", "stays")]).select(
        F.lit(True).alias("is_total"), F.lit(None).cast("string").alias("key"), "*"
    )
    if group_by != "none":
        rows = rows.unionByName(sums.withColumn("is_total", F.lit(False)))
    return rows.select(
        "is_total", "key",
        F.coalesce(F.col("revenue").cast("double"), F.lit(0.0)).alias("revenue_sum"),
        F.coalesce("nights", F.lit(0)).cast("bigint").alias("occupied_room_nights"),
        F.coalesce(F.col("rates").cast("double") / F.nullif("rated", F.lit(0)), F.lit(0.0)).alias("arr_simple"),
        F.coalesce("stays", F.lit(0)).cast("bigint").alias("bookings_count"),
    )


def list_dimensions(df: DataFrame, start, end) -> DataFrame:
    """(dimension, value): distinct non-blank values among overlapping stays, one pass over the data."""
    stays = overlap_filter(df, start, end)
    stacked = stays.select(
        F.explode(F.array(*[
            F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in DIMENSIONS
        ])).alias("x")
    ).select("x.*")
    return stacked.filter(F.col("value").isNotNull() & (F.col("value") != "")).distinct()


def merge_multi_row_stays(df: DataFrame, keys=("guest_name", "arrival_date", "depart_date", "room_number"),
                          line="line_no", means=("room_rate", "lodging", "breakfast", "lunch", "dinner", "other_charges")):
    """Several export rows of one stay -> one: mean of the money columns, first non-null of the others in file order."""
    firsts = [c for c in df.columns if c not in (*keys, *means, line)]
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(
        *[F.avg(c).alias(c) for c in means if c in df.columns],
        *[F.min_by(c, F.struct(F.col(c).isNull(), F.col(line))).alias(c) for c in firsts],
    )
