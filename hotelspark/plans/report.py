"""Occupancy, revenue and comparison reports."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hotelspark.operators.rooms import rooms_as_of
from hotelspark.operators.stays import (
    as_day, clip_stays, dimension_filters, group_key, nights_of_spans, spans, split_list,
)

MEASURES = (
    "room_sold", "bookings_count", "room_count", "revenue_sum", "occupancy_rate", "average_occupancy_rate",
    "arr_simple", "adr_simple",
)


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom as double, 0 where the bottom is missing or not positive."""
    return F.when(bottom > 0, top.cast("double") / bottom.cast("double")).otherwise(F.lit(0.0))


def top_n_with_other(df: DataFrame, key: str, measure: str, n: int, include_other: bool = False,
                     sums: tuple[str, ...] | None = None) -> DataFrame:
    """The n largest rows by measure (ties by key) and, on request, one 'Other' row summing the rest.

    ``df`` has one row per key. The head is a bounded top-k, so nothing is sorted in a single task, and its last row
    tells the other rows apart without a join. Columns outside ``sums`` are null in the 'Other' row.
    """
    head = df.orderBy(F.col(measure).desc(), F.col(key)).limit(n)
    if not include_other:
        return head
    kinds = dict(df.dtypes)
    sums = sums or tuple(c for c, t in df.dtypes if c != key and t != "string")
    # Grows with the rank; a missing measure stands last.
    rank = F.struct(F.col(measure).isNull().alias("n"), (-F.col(measure)).alias("m"), F.col(key).alias("k"))
    edge = head.agg(F.max(rank)).scalar()
    is_head = F.coalesce(rank <= edge, F.lit(False))
    marked = df.withColumn("_head", is_head)
    grouped = marked.groupBy(F.when(F.col("_head"), F.col(key)).otherwise(F.lit("Other")).alias("_key"), "_head").agg(
        *[F.sum(c).cast(kinds[c]).alias(c) for c in sums],
        *[F.max(F.when(F.col("_head"), F.col(c))).alias(c) for c in df.columns if c not in (*sums, key)])
    return grouped.withColumnRenamed("_key", key).select(*df.columns)


def occupancy_report(
    resv: DataFrame, builds: DataFrame, start, end, group_by: str = "none", filters: Mapping | None = None,
    top_n: int | None = None, include_other: bool = False, corrected: bool = False,
) -> DataFrame:
    """Totals and breakdown of a period: one row with ``is_total`` and one per group.

    Default results follow the established report column by column:

    * a stay counts on its departure day too;
    * average_occupancy_rate and adr_simple are sums of daily ratios for room types and totals, and equal
      occupancy_rate and arr_simple in the other breakdowns;
    * outside the room type grouping every group carries the whole period's room count;
    * totals add up the breakdown that is shown, so a dropped tail is missing from them;
    * deleted stays count.

    ``corrected=True`` leaves out the departure day and deleted stays, divides daily sums by the number of
    days and takes totals from the data instead of the shown breakdown.
    """
    filters = dict(filters or {})
    if corrected:
        if "is_deleted" in resv.columns:
            resv = resv.filter(F.coalesce(F.col("is_deleted"), F.lit(0)) == 0)
        resv = resv.withColumn("depart_date", F.greatest(
            F.date_sub(F.col("depart_date").cast("date"), 1), F.col("arrival_date").cast("date")
        ))
    by_type = group_by == "room_type_desc"
    wanted = split_list(filters.get("room_type_desc"))
    key = F.lit("") if group_by == "none" else group_key(group_by)
    # Blank keys are one hidden group: part of the nightly totals, never shown.
    stays = dimension_filters(resv, filters).withColumn("key", F.when(F.trim(key) != "", key).otherwise(F.lit("")))
    dims = [F.col("key"), F.col("room_type_desc").isNotNull().alias("typed")]
    sales = spans(stays, start, end, *dims)
    pairs = clip_stays(stays, start, end).select("key", "reservation_id").distinct()
    rooms = rooms_as_of(builds, start, end, wanted or None)

    nightly = _nightly(sales, rooms, by_type)
    if by_type and not wanted:
        nightly = _only_sold_types(nightly)
    days = F.datediff(as_day(end), as_day(start)) + 1 if corrected else F.lit(1)
    totals = _period_totals(nightly, days.cast("double"))
    per_key = _per_key(sales, pairs, nightly if by_type else None, days.cast("double"))
    if not by_type:
        per_key = per_key.withColumn("room_count", totals.select("room_count").scalar())
    out = _assemble(per_key, totals, top_n if group_by != "none" else None, include_other, by_type, corrected)
    if not corrected:
        return out
    booked = pairs.agg(F.countDistinct("reservation_id")).scalar()
    return out.withColumn("bookings_count", F.when(F.col("is_total"), booked).otherwise(F.col("bookings_count")))


def _nightly(sales: DataFrame, rooms: DataFrame, by_type: bool) -> DataFrame:
    """(key, stay_date): decimal revenue, rooms sold and rooms available, sales and capacity stacked, not joined."""
    kind = F.col("room_type_desc") if by_type else F.lit("")
    sold = nights_of_spans(sales.filter("typed").withColumn("key", F.col("key") if by_type else F.lit("")), "key")
    capacity = rooms.select(
        "stay_date", kind.alias("key"), F.lit(None).cast("decimal(38,2)").alias("revenue_sum"),
        F.lit(0).cast("bigint").alias("room_sold"), "room_count",
    )
    return sold.withColumn("room_count", F.lit(0).cast("bigint")).unionByName(capacity).groupBy("key", "stay_date").agg(
        F.sum("revenue_sum").alias("revenue"), F.sum("room_sold").alias("sold"), F.sum("room_count").alias("rooms")
    ).withColumn("counted", F.lit(True))


def _only_sold_types(nightly: DataFrame) -> DataFrame:
    """Capacity counts for the types that were sold, or for all of them when none was.

    The window holds one type's days, so it is bounded by the length of the period.
    """
    by_key = Window.partitionBy("key")
    return nightly.withColumn("counted", (F.max("sold").over(by_key) > 0) & (F.col("key") != ""))


def _period_totals(nightly: DataFrame, days: Column) -> DataFrame:
    """One row: room_count of the period and the sums of the daily ratios over all types."""
    counted = F.when(F.col("counted"), F.col("rooms"))
    daily = nightly.groupBy("stay_date").agg(
        F.sum("revenue").alias("revenue"), F.sum("sold").alias("sold"), F.sum("rooms").alias("all_rooms"),
        F.sum(counted).alias("counted_rooms"), F.max("counted").alias("any"),
    )
    # When no type was sold at all no day has a counted type, and all capacity counts.
    one = daily.agg(
        F.max("any").alias("any"), F.sum("all_rooms").alias("all_rooms"), F.sum("counted_rooms").alias("counted_rooms"),
        F.sum(ratio(F.col("sold"), F.col("counted_rooms"))).alias("occ"),
        F.sum(ratio(F.col("sold"), F.col("all_rooms"))).alias("occ_all"),
        F.sum(ratio(F.col("revenue"), F.col("sold"))).alias("adr"),
    )
    pick = lambda yes, no: F.coalesce(F.when(F.col("any"), F.col(yes)).otherwise(F.col(no)), F.lit(0))
    return one.select(
        pick("counted_rooms", "all_rooms").cast("bigint").alias("room_count"),
        (pick("occ", "occ_all") / days).alias("average_occupancy_rate"),
        (F.coalesce("adr", F.lit(0.0)) / days).alias("adr_simple"),
    )


def _per_key(sales: DataFrame, pairs: DataFrame, nightly: DataFrame | None, days: Column) -> DataFrame:
    """One row per key, the hidden one included: sold, revenue, bookings and (by type) capacity and day sums."""
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("decimal(38,2)")
    flat = F.lit(0.0)
    parts = [
        sales.select(
            "key", (F.col("stays") * F.col("days")).alias("room_sold"),
            (F.col("rates") * F.col("days")).cast("decimal(38,2)").alias("revenue"), zero.alias("bookings_count"),
            zero.alias("room_count"), flat.alias("occ"), flat.alias("adr"),
        ),
        pairs.select(
            "key", zero, none, F.when(F.col("reservation_id").isNotNull(), 1).otherwise(0).cast("bigint"), zero, flat, flat
        ),
    ]
    if nightly is not None:
        parts.append(nightly.select(
            "key", zero, none, zero, "rooms", ratio(F.col("sold"), F.col("rooms")), ratio(F.col("revenue"), F.col("sold")),
        ))
    stacked = reduce(DataFrame.unionAll, parts)
    names = ("room_sold", "revenue", "bookings_count", "room_count", "occ", "adr")
    return stacked.groupBy("key").agg(*[F.sum(c).alias(c) for c in names]).filter("room_sold > 0").select(
        "key", "room_sold", F.coalesce(F.col("revenue").cast("double"), F.lit(0.0)).alias("revenue_sum"),
        "bookings_count", "room_count", (F.col("occ") / days).alias("occ"), (F.col("adr") / days).alias("adr"),
    )


def _assemble(per_key: DataFrame, totals: DataFrame, top_n: int | None, include_other: bool, by_type: bool,
              corrected: bool) -> DataFrame:
    """Head rows, the 'Other' row and the total row, by letting each group add to the rows it belongs to."""
    shown = F.col("key") != ""
    if top_n:
        ranked = per_key.filter(shown).orderBy(F.col("revenue_sum").desc(), "key").limit(top_n)
        # The last row of the head, kept as one struct: (negative revenue, key) grows with the rank.
        edge = ranked.agg(F.max(F.struct((-F.col("revenue_sum")).alias("r"), F.col("key").alias("k")))).scalar()
        head = F.struct((-F.col("revenue_sum")).alias("r"), F.col("key").alias("k")) <= edge
    else:
        head = F.lit(True)
    per_key = per_key.withColumn("_head", head)
    head, label = F.col("_head"), F.col("_label")
    per_key = per_key.withColumn("_label", F.when(head, F.col("key")).when(F.lit(include_other), F.lit("Other")))
    counted = F.lit(True) if corrected else shown & label.isNotNull()
    row = lambda total, key, is_shown, daily: F.struct(
        F.lit(total).alias("is_total"), key.alias("label"), is_shown.alias("is_shown"), daily.alias("daily")
    )
    members = F.array_compact(
        F.array(
            F.when(shown & label.isNotNull(), row(False, label, F.lit(True), head if by_type else F.lit(False))),
            # The hidden group reaches the total only when nothing is shown.
            F.when(counted | ~shown, row(True, F.lit(None).cast("string"), counted, F.lit(False))),
        )
    )
    sums = ("room_sold", "bookings_count", "room_count", "revenue_sum")
    spread = per_key.select("*", F.explode(members).alias("m")).select(
        "m.*", *sums, "occ", "adr", F.lit(None).cast("bigint").alias("all_rooms"),
    )
    base = totals.select(
        F.lit(True).alias("is_total"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("is_shown"),
        F.lit(True).alias("daily"), *[F.lit(0).cast("double" if c == "revenue_sum" else "bigint").alias(c) for c in sums],
        F.col("average_occupancy_rate").alias("occ"), F.col("adr_simple").alias("adr"),
        F.col("room_count").alias("all_rooms"),
    )
    is_shown, daily = F.col("is_shown"), F.col("daily")
    pick = lambda c: F.coalesce(
        F.sum(F.when(is_shown, F.col(c))), F.max("all_rooms") if c == "room_count" else F.sum(c)
    )
    out = spread.unionByName(base).groupBy("is_total", "label").agg(
        *[pick(c).alias(c) for c in sums], F.max("daily").alias("daily"),
        F.sum(F.when(daily, F.col("occ"))).alias("occ"), F.sum(F.when(daily, F.col("adr"))).alias("adr"),
        F.max("all_rooms").alias("all_rooms"),
    )
    if corrected:
        out = out.withColumn("room_count", F.when(F.col("is_total"), F.col("all_rooms")).otherwise(F.col("room_count")))
    out = out.withColumns({
        "occupancy_rate": ratio(F.col("room_sold"), F.col("room_count")),
        "arr_simple": ratio(F.col("revenue_sum"), F.col("room_sold")),
    })
    return out.select(
        "is_total", F.col("label").alias("key"), "room_sold", "bookings_count", "room_count", "revenue_sum", "occupancy_rate",
        F.when(daily, F.col("occ")).otherwise(F.col("occupancy_rate")).alias("average_occupancy_rate"), "arr_simple",
        F.when(daily, F.col("adr")).otherwise(F.col("arr_simple")).alias("adr_simple"),
    )


def share_of_total(df: DataFrame, measure: str) -> DataFrame:
    """Percentage of the total with one decimal, 0 when the total is not positive."""
    total = df.agg(F.sum(measure)).scalar()
    share = F.round(F.col(measure).cast("double") / total.cast("double") * 100, 1)
    return df.withColumn("share_pct", F.when(total > 0, share).otherwise(F.lit(0.0)))


def fixed_capacity_occupancy(df: DataFrame, rooms: int, sold: str = "room_sold", days: str = "period_days") -> DataFrame:
    """Occupancy in percent of rooms x days, at most 100, and 0 without rooms."""
    seats = F.lit(rooms) * F.when(F.coalesce(F.col(days), F.lit(0)) > 0, F.col(days)).otherwise(F.lit(1))
    return df.withColumn("occupancy_pct", F.least(F.lit(100.0), ratio(F.col(sold), seats) * 100))


def default_period(resv: DataFrame, days: int = 7) -> DataFrame:
    """One row: the last departure day and the day a week before it."""
    return resv.agg(F.max("depart_date").cast("date").alias("period_end")).select(
        F.date_sub("period_end", days).alias("period_start"), "period_end"
    )


def compare_periods(resv: DataFrame, builds: DataFrame, spec_a: Mapping, spec_b: Mapping) -> DataFrame:
    """Two reports side by side by group: every measure of both periods and the change b - a.

    A spec holds the arguments of :func:`occupancy_report`; what spec_b leaves out is taken from spec_a.
    """
    spec_b = {**spec_a, **spec_b}
    a, b = (occupancy_report(resv, builds, **spec) for spec in (spec_a, spec_b))
    left = a.select("is_total", "key", *[F.col(m).alias(f"{m}_a") for m in MEASURES])
    right = b.select(F.col("is_total").alias("_t"), F.col("key").alias("_k"), *[F.col(m).alias(f"{m}_b") for m in MEASURES])
    joined = left.join(
        right, (F.col("is_total") == F.col("_t")) & F.col("key").eqNullSafe(F.col("_k")), "full_outer"
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select(
        F.coalesce("is_total", "_t").alias("is_total"), F.coalesce("key", "_k").alias("key"),
        *[x for m in MEASURES for x in (
            zero(f"{m}_a").alias(f"{m}_a"), zero(f"{m}_b").alias(f"{m}_b"),
            (zero(f"{m}_b") - zero(f"{m}_a")).alias(f"{m}_change"),
        )],
    )


def dashboard_stats(profiles: DataFrame, resv: DataFrame, chats: DataFrame, resto: DataFrame) -> DataFrame:
    """One row: row counts of the four marts, last departure day, last load time."""
    count = lambda df: df.agg(F.count(F.lit(1))).scalar()
    return resv.agg(
        F.count(F.lit(1)).alias("total_reservations"), F.max("depart_date").alias("_depart"),
        F.max("ingested_at").alias("last_updated"),
    ).select(
        count(profiles).alias("total_guests"), "total_reservations", count(chats).alias("total_chats"),
        count(resto).alias("total_transactions"), F.col("_depart").cast("date").alias("latest_depart_date"),
        "last_updated",
    )


def analytics_daily(resv: DataFrame) -> DataFrame:
    """Daily pre-aggregate by day and four dimensions, for reports that read many periods."""
    bounds = resv.withColumns({
        "first_day": F.col("arrival_date").cast("date"), "last_day": F.col("depart_date").cast("date"),
    }).filter(F.col("first_day") <= F.col("last_day"))
    dims = ["segment", "room_type_desc", "local_region", "nationality"]
    summed = bounds.groupBy(*dims, "first_day", "last_day").agg(
        F.sum("room_rate").alias("rates"), F.count("room_rate").alias("rated"), F.count(F.lit(1)).alias("stays")
    )
    expand = lambda df: df.withColumn("stay_date", F.explode(F.sequence("first_day", "last_day")))
    measures = expand(summed).groupBy("stay_date", *dims).agg(
        F.sum("rates").alias("_rates"), F.sum("rated").alias("_rated"), F.sum("stays").alias("room_nights_sum")
    )
    distinct = bounds.select(*dims, "first_day", "last_day", "reservation_id").distinct()
    booked = expand(distinct).groupBy("stay_date", *dims).agg(F.countDistinct("reservation_id").alias("bookings_count"))
    same = reduce(
        lambda x, y: x & y, [F.col(f"m.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("stay_date", *dims)]
    )
    return measures.alias("m").join(booked.alias("b"), same, "left").select(
        *[F.col(f"m.{c}") for c in ("stay_date", *dims)],
        F.coalesce(F.col("_rates").cast("double"), F.lit(0.0)).alias("revenue_sum"), "room_nights_sum",
        ratio(F.col("_rates"), F.col("_rated")).alias("arr_simple"),
        F.coalesce("bookings_count", F.lit(0)).alias("bookings_count"),
    )


def repeat_guest_rate(resv: DataFrame, start=None, end=None, guest: str = "guest_id") -> DataFrame:
    """One row: distinct guests, guests with more than one stay, and their ratio."""
    if start is not None:
        resv = resv.filter(F.col("arrival_date") >= as_day(start))
    if end is not None:
        resv = resv.filter(F.col("arrival_date") <= as_day(end))
    stays = resv.filter(F.col(guest).isNotNull()).groupBy(guest).agg(F.count(F.lit(1)).alias("n"))
    return stays.agg(
        F.count(F.lit(1)).alias("guests"), F.count(F.when(F.col("n") > 1, 1)).alias("repeat_guests")
    ).withColumn("repeat_rate", ratio(F.col("repeat_guests"), F.col("guests")))


def kpi_report(resv: DataFrame, builds: DataFrame, start, end, created: str | None = None) -> DataFrame:
    """One row: room nights, revenue, ADR, RevPAR, mean length of stay and lead time of stays in the period.

    Lead time is arrival minus the ``created`` day, null when no such column is named.
    """
    stays = clip_stays(resv, start, end)
    lead = F.datediff(F.col("arrival_date"), F.col(created).try_cast("date")) if created else F.lit(None).cast("int")
    one = stays.withColumn("days", F.datediff("last_day", "first_day") + 1).agg(
        F.coalesce(F.sum("days"), F.lit(0)).alias("room_nights"),
        F.coalesce(F.sum(F.col("room_rate") * F.col("days")).cast("double"), F.lit(0.0)).alias("revenue"),
        F.avg("nights").alias("length_of_stay"), F.avg(lead).alias("lead_time_days"),
    )
    available = rooms_as_of(builds, start, end).agg(F.coalesce(F.sum("room_count"), F.lit(0))).scalar()
    return one.withColumn("rooms_available", available).withColumns({
        "adr": ratio(F.col("revenue"), F.col("room_nights")),
        "revpar": ratio(F.col("revenue"), F.col("rooms_available")),
    })


def kpi_trend(resv: DataFrame, window_months: int = 3) -> DataFrame:
    """Monthly revenue by arrival month with a moving mean and change against last month and last year.

    Windows run over one row per calendar month, so their single partition is bounded by the calendar.
    """
    monthly = resv.groupBy(F.trunc("arrival_date", "month").alias("month")).agg(
        F.sum(F.col("room_rate") * F.col("nights")).cast("double").alias("revenue"),
        F.sum("nights").alias("room_nights"),
    )
    number = F.year("month") * 12 + F.month("month")
    ordered = Window.orderBy("_m")
    at = lambda back: F.max("revenue").over(ordered.rangeBetween(-back, -back))
    change = lambda back: F.when(at(back) > 0, F.col("revenue") / at(back) - 1)
    return monthly.withColumn("_m", number).select(
        "month", "revenue", "room_nights",
        F.avg("revenue").over(ordered.rangeBetween(1 - window_months, 0)).alias("revenue_moving_avg"),
        change(1).alias("mom_change"), change(12).alias("yoy_change"),
    )
