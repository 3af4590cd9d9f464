"""The occupancy report in its groupings, comparisons and dashboard figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from hotelspark.operators import stays
from hotelspark.plans import report
from hotelspark.plans import sql as readonly
from hotelspark.workload.aggregates import ROOMS_SQL, key_sql
from hotelspark.workload.registry import query, rounded

VIEWS = ("fx_reservations", "fx_room_builds")
R = ("fx_reservations",)


def report_ctes(start: str, end: str, group_by: str, where: str = "", types: str = "", top_n: int | None = None,
                include_other: bool = False, p: str = "") -> str:
    """WITH members for one report, rule by rule; the last member is {p}report. ``p`` prefixes their names."""
    by_type = group_by == "room_type_desc"
    room_filter = f"WHERE room_type_desc IN ({types})" if types else (
        f"WHERE room_type_desc IN (SELECT key FROM {p}shown) OR NOT EXISTS (SELECT 1 FROM {p}shown)" if by_type else ""
    )
    rooms = ROOMS_SQL.format(start=start, end=end).replace("days AS", f"{p}days AS").replace("FROM days", f"FROM {p}days")
    rooms = rooms.replace("latest AS", f"{p}latest AS").replace("FROM latest", f"FROM {p}latest").replace("rooms AS", f"{p}allrooms AS")
    group_rows = f"""
, {p}groups AS (SELECT s.key, s.sold, s.books, COALESCE(t.n, 0) AS room_count, s.rev, COALESCE(o.occ, 0.0) AS avg_occ, COALESCE(o.adr, 0.0) AS adr
  FROM {p}shown s LEFT JOIN {p}typerooms t ON t.room_type_desc = s.key LEFT JOIN {p}typeday o ON o.room_type_desc = s.key)
""" if by_type else f"""
, {p}groups AS (SELECT s.key, s.sold, s.books, (SELECT n FROM {p}total) AS room_count, s.rev,
  CASE WHEN (SELECT n FROM {p}total) > 0 THEN s.sold::DOUBLE / (SELECT n FROM {p}total) ELSE 0.0 END AS avg_occ,
  CASE WHEN s.sold > 0 THEN s.rev / s.sold ELSE 0.0 END AS adr FROM {p}shown s)
"""
    if top_n:
        final = f"""
, {p}ranked AS (SELECT *, row_number() OVER (ORDER BY rev DESC, key) AS rk FROM {p}groups),
{p}final AS (SELECT key, sold, books, room_count, rev, avg_occ, adr FROM {p}ranked WHERE rk <= {top_n}""" + (f"""
  UNION ALL SELECT 'Other', sum(sold), sum(books), sum(room_count), sum(rev),
  CASE WHEN sum(room_count) > 0 THEN sum(sold)::DOUBLE / sum(room_count) ELSE 0.0 END,
  CASE WHEN sum(sold) > 0 THEN sum(rev) / sum(sold) ELSE 0.0 END FROM {p}ranked WHERE rk > {top_n} HAVING count(*) > 0)"""
            if include_other else ")")
    else:
        final = f", {p}final AS (SELECT * FROM {p}groups)"
    return f"""
, {p}x AS (SELECT *, {key_sql(group_by)} AS gkey, CAST(unnest(generate_series(CAST(greatest(arrival_date, DATE '{start}') AS TIMESTAMP),
  CAST(least(depart_date, DATE '{end}') AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day
  FROM fx_reservations WHERE arrival_date <= DATE '{end}' AND depart_date >= DATE '{start}' {where}),
{p}shown AS (SELECT gkey AS key, count(*) AS sold, count(DISTINCT reservation_id) AS books, COALESCE(sum(room_rate)::DOUBLE, 0.0) AS rev
  FROM {p}x WHERE trim(gkey) <> '' GROUP BY gkey),
{p}whole AS (SELECT count(*) AS sold, count(DISTINCT reservation_id) AS books, COALESCE(sum(room_rate)::DOUBLE, 0.0) AS rev FROM {p}x)
{rooms}, {p}rooms AS (SELECT * FROM {p}allrooms {room_filter}),
{p}total AS (SELECT COALESCE(sum(room_count), 0) AS n FROM {p}rooms),
{p}typerooms AS (SELECT room_type_desc, sum(room_count) AS n FROM {p}rooms GROUP BY room_type_desc),
{p}nightly AS (SELECT day, room_type_desc, sum(room_rate)::DOUBLE AS rev, count(*) AS sold FROM {p}x WHERE room_type_desc IS NOT NULL GROUP BY day, room_type_desc),
{p}typeday AS (SELECT n.room_type_desc, sum(CASE WHEN r.room_count > 0 THEN n.sold::DOUBLE / r.room_count ELSE 0.0 END) AS occ, sum(n.rev / n.sold) AS adr
  FROM {p}nightly n LEFT JOIN {p}rooms r ON r.day = n.day AND r.room_type_desc = n.room_type_desc GROUP BY n.room_type_desc),
{p}daily AS (SELECT day, sum(sold) AS sold, sum(rev) AS rev FROM {p}nightly GROUP BY day),
{p}dayrooms AS (SELECT day, sum(room_count) AS n FROM {p}rooms GROUP BY day),
{p}sums AS (SELECT COALESCE(sum(CASE WHEN r.n > 0 THEN d.sold::DOUBLE / r.n ELSE 0.0 END), 0.0) AS occ, COALESCE(sum(d.rev / d.sold), 0.0) AS adr
  FROM {p}daily d LEFT JOIN {p}dayrooms r ON r.day = d.day)
{group_rows}{final}
, {p}tot AS (SELECT CASE WHEN count(*) > 0 THEN sum(sold) ELSE (SELECT sold FROM {p}whole) END AS sold,
  CASE WHEN count(*) > 0 THEN sum(books) ELSE (SELECT books FROM {p}whole) END AS books,
  CASE WHEN count(*) > 0 THEN sum(room_count) ELSE (SELECT n FROM {p}total) END AS room_count,
  CASE WHEN count(*) > 0 THEN sum(rev) ELSE (SELECT rev FROM {p}whole) END AS rev FROM {p}final {"WHERE FALSE" if group_by == "none" else ""}),
{p}rowset AS (SELECT TRUE AS is_total, NULL::VARCHAR AS key, sold, books, room_count, rev, (SELECT occ FROM {p}sums) AS avg_occ, (SELECT adr FROM {p}sums) AS adr FROM {p}tot
  {"" if group_by == "none" else f"UNION ALL SELECT FALSE, key, sold, books, room_count, rev, avg_occ, adr FROM {p}final"}),
{p}report AS (SELECT is_total, key, sold::BIGINT AS room_sold, books::BIGINT AS bookings_count, room_count::BIGINT AS room_count, round(rev, 2) AS revenue_sum,
  round(CASE WHEN room_count > 0 THEN sold::DOUBLE / room_count ELSE 0.0 END, 6) AS occupancy_rate, round(avg_occ, 6) AS average_occupancy_rate,
  round(CASE WHEN sold > 0 THEN rev / sold ELSE 0.0 END, 4) AS arr_simple, round(adr, 3) AS adr_simple FROM {p}rowset)"""


_DIGITS = {"revenue_sum": 2, "occupancy_rate": 6, "average_occupancy_rate": 6, "arr_simple": 4, "adr_simple": 3}


def _round(df, suffix=""):
    return df.withColumns({
        f"{c}{suffix}": F.round(f"{c}{suffix}", d) for c, d in _DIGITS.items()
    })


def _register(name: str, start: str, end: str, group_by: str, filters=None, where="", types="", top_n=None, include_other=False):
    sql = report_ctes(start, end, group_by, where, types, top_n, include_other) + "\nSELECT * FROM report"

    @query(name, sql, VIEWS)
    def _(load):
        return _round(report.occupancy_report(
            load("fx_reservations"), load("fx_room_builds"), start, end, group_by, filters, top_n, include_other
        ))


_register("report_total", "1998-03-01", "1998-03-31", "none")
_register("report_by_segment", "1998-03-01", "1998-03-31", "segment")
_register("report_by_room_type", "1998-03-01", "1998-03-31", "room_type_desc")
_register("report_by_room_type_full_history", "1992-01-01", "2001-12-31", "room_type_desc")
_register("report_by_region", "1997-06-01", "1997-06-30", "local_region")
_register("report_by_nationality_top5_other", "1998-03-01", "1998-03-31", "nationality", top_n=5, include_other=True)
_register("report_by_age_top3", "1998-03-01", "1998-03-31", "age_group", top_n=3)
_register("report_by_room_type_top2_other", "1998-03-01", "1998-03-31", "room_type_desc", top_n=2, include_other=True)
_register("report_by_segment_filtered", "1998-03-01", "1998-03-31", "segment",
          {"room_type_desc": "Deluxe,Suite", "segment": "BUILDING, HOUSEHOLD,"},
          "AND room_type_desc IN ('Deluxe', 'Suite') AND segment IN ('BUILDING', 'HOUSEHOLD')", "'Deluxe', 'Suite'")
_register("report_by_room_type_filtered", "1998-03-01", "1998-03-31", "room_type_desc",
          {"room_type_desc": "Deluxe,Suite"}, "AND room_type_desc IN ('Deluxe', 'Suite')", "'Deluxe', 'Suite'")


@query("report_corrected_total", """
, c AS (SELECT *, CASE WHEN depart_date - 1 > arrival_date THEN depart_date - 1 ELSE arrival_date END AS last_day FROM fx_reservations WHERE deleted_at IS NULL),
x AS (SELECT *, CAST(unnest(generate_series(CAST(greatest(arrival_date, DATE '1998-03-01') AS TIMESTAMP), CAST(least(last_day, DATE '1998-03-31') AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day
  FROM c WHERE arrival_date <= DATE '1998-03-31' AND last_day >= DATE '1998-03-01')""" + ROOMS_SQL.format(start="1998-03-01", end="1998-03-31") + """
SELECT count(*)::BIGINT AS room_sold, count(DISTINCT reservation_id)::BIGINT AS bookings_count, (SELECT sum(room_count) FROM rooms)::BIGINT AS room_count,
  round(sum(room_rate)::DOUBLE, 2) AS revenue_sum, round(count(*)::DOUBLE / (SELECT sum(room_count) FROM rooms), 6) AS occupancy_rate FROM x""", VIEWS)
def _(load):
    stays_ = load("fx_reservations").withColumn("is_deleted", F.col("deleted_at").isNotNull().cast("int"))
    out = report.occupancy_report(stays_, load("fx_room_builds"), "1998-03-01", "1998-03-31", "local_region", corrected=True)
    return _round(out.filter("is_total")).select("room_sold", "bookings_count", "room_count", "revenue_sum", "occupancy_rate")


@query("segments_top3_with_other", """
, g AS (SELECT COALESCE(segment, 'Unknown') AS key, count(*)::BIGINT AS stays, sum(room_rate)::DOUBLE AS revenue FROM fx_reservations GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY revenue DESC, key) AS rk FROM g)
SELECT key, stays, round(revenue, 2) AS revenue FROM r WHERE rk <= 3
UNION ALL SELECT 'Other', sum(stays)::BIGINT, round(sum(revenue), 2) FROM r WHERE rk > 3 HAVING count(*) > 0""", R)
def _(load):
    groups = load("fx_reservations").groupBy(stays.group_key("segment").alias("key")).agg(
        F.count(F.lit(1)).alias("stays"), F.sum("room_rate").cast("double").alias("revenue")
    )
    return rounded(report.top_n_with_other(groups, "key", "revenue", 3, include_other=True), 2)


@query("guests_top10_by_revenue", """
SELECT guest_id, sum(room_rate)::DOUBLE AS revenue FROM fx_reservations GROUP BY guest_id ORDER BY sum(room_rate) DESC, guest_id LIMIT 10""", R)
def _(load):
    groups = load("fx_reservations").groupBy("guest_id").agg(F.sum("room_rate").alias("revenue"))
    return report.top_n_with_other(groups, "guest_id", "revenue", 10)


def _compare_sql() -> str:
    measures = ", ".join(
        f"COALESCE(a.{m}, 0) AS {m}_a, COALESCE(b.{m}, 0) AS {m}_b" for m in report.MEASURES
    )
    return (
        report_ctes("1998-03-01", "1998-03-31", "segment", p="a_") + report_ctes("1997-03-01", "1997-03-31", "segment", p="b_") + f"""
SELECT COALESCE(a.is_total, b.is_total) AS is_total, COALESCE(a.key, b.key) AS key, {measures}
FROM a_report a FULL JOIN b_report b ON a.is_total = b.is_total AND a.key IS NOT DISTINCT FROM b.key""")


@query("periods_compared", _compare_sql(), VIEWS)
def _(load):
    out = report.compare_periods(
        load("fx_reservations"), load("fx_room_builds"), {"start": "1998-03-01", "end": "1998-03-31", "group_by": "segment"},
        {"start": "1997-03-01", "end": "1997-03-31"},
    )
    out = _round(_round(out, "_a"), "_b")
    return out.select("is_total", "key", *[f"{m}_{s}" for m in report.MEASURES for s in "ab"])


@query("segment_shares", """
, g AS (SELECT COALESCE(segment, 'Unknown') AS key, count(*)::BIGINT AS stays FROM fx_reservations GROUP BY 1)
SELECT key, stays, round(stays::DOUBLE / (SELECT sum(stays) FROM g)::DOUBLE * 100, 1) AS share_pct FROM g""", R)
def _(load):
    groups = load("fx_reservations").groupBy(stays.group_key("segment").alias("key")).agg(F.count(F.lit(1)).alias("stays"))
    return report.share_of_total(groups, "stays")


@query("occupancy_of_fixed_capacity", """
, x AS (SELECT COALESCE(segment, 'Unknown') AS key, date_diff('day', greatest(arrival_date, DATE '1998-03-01'), least(depart_date, DATE '1998-03-31')) + 1 AS n
  FROM fx_reservations WHERE arrival_date <= DATE '1998-03-31' AND depart_date >= DATE '1998-03-01')
SELECT key, sum(n)::BIGINT AS room_sold, round(least(100.0, sum(n)::DOUBLE / (120 * 31) * 100), 6) AS occupancy_pct FROM x WHERE trim(key) <> '' GROUP BY key
UNION ALL SELECT NULL, sum(n)::BIGINT, round(least(100.0, sum(n)::DOUBLE / (120 * 31) * 100), 6) FROM x""", R)
def _(load):
    nights = stays.room_night_aggregate(load("fx_reservations"), "1998-03-01", "1998-03-31", "segment")
    return rounded(report.fixed_capacity_occupancy(nights, 120).select("key", "room_sold", "occupancy_pct"), 6)


@query("default_report_period", """
SELECT (max(depart_date) - 7)::DATE::VARCHAR AS period_start, max(depart_date)::VARCHAR AS period_end FROM fx_reservations""", R)
def _(load):
    return report.default_period(load("fx_reservations"))


@query("dashboard", """
SELECT (SELECT count(*) FROM fx_profiles)::BIGINT AS total_guests, (SELECT count(*) FROM fx_reservations)::BIGINT AS total_reservations,
  (SELECT count(*) FROM fx_chats)::BIGINT AS total_chats, (SELECT count(*) FROM fx_bills)::BIGINT AS total_transactions,
  (SELECT max(depart_date)::VARCHAR FROM fx_reservations) AS latest_depart_date, (SELECT max(version) FROM fx_reservations) AS last_updated""",
       ("fx_reservations", "fx_profiles", "fx_chats", "fx_bills"))
def _(load):
    return report.dashboard_stats(
        load("fx_profiles"), load("fx_reservations").withColumnRenamed("version", "ingested_at"), load("fx_chats"), load("fx_bills")
    )


@query("daily_preaggregate", """
, x AS (SELECT *, CAST(unnest(generate_series(CAST(arrival_date AS TIMESTAMP), CAST(depart_date AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS stay_date FROM fx_reservations)
SELECT stay_date::VARCHAR AS stay_date, segment, room_type_desc, local_region, nationality, sum(room_rate)::DOUBLE AS revenue_sum, count(*)::BIGINT AS room_nights_sum,
  round(sum(room_rate)::DOUBLE / count(room_rate), 4) AS arr_simple, count(DISTINCT reservation_id)::BIGINT AS bookings_count
FROM x GROUP BY x.stay_date, segment, room_type_desc, local_region, nationality""", R)
def _(load):
    return rounded(report.analytics_daily(load("fx_reservations")))


@query("repeat_guests", """
, g AS (SELECT guest_id, count(*) AS n FROM fx_reservations WHERE arrival_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' GROUP BY guest_id)
SELECT count(*)::BIGINT AS guests, count(*) FILTER (WHERE n > 1)::BIGINT AS repeat_guests, round(count(*) FILTER (WHERE n > 1)::DOUBLE / count(*), 6) AS repeat_rate FROM g""", R)
def _(load):
    return rounded(report.repeat_guest_rate(load("fx_reservations"), "1997-01-01", "1997-12-31"), 6)


@query("kpis_of_period", """
, s AS (SELECT *, date_diff('day', greatest(arrival_date, DATE '1998-03-01'), least(depart_date, DATE '1998-03-31')) + 1 AS days
  FROM fx_reservations WHERE arrival_date <= DATE '1998-03-31' AND depart_date >= DATE '1998-03-01')""" + ROOMS_SQL.format(start="1998-03-01", end="1998-03-31") + """
, o AS (SELECT sum(days)::BIGINT AS room_nights, sum(room_rate * days)::DOUBLE AS revenue, avg(nights) AS los, avg(30) AS lead FROM s),
a AS (SELECT sum(room_count)::BIGINT AS n FROM rooms)
SELECT room_nights, round(revenue, 2) AS revenue, round(los, 4) AS length_of_stay, round(lead, 4) AS lead_time_days, n AS rooms_available,
  round(revenue / room_nights, 4) AS adr, round(revenue / n, 4) AS revpar FROM o, a""", VIEWS)
def _(load):
    booked = load("fx_reservations").withColumn("created", F.date_sub("arrival_date", 30))
    out = rounded(report.kpi_report(booked, load("fx_room_builds"), "1998-03-01", "1998-03-31", created="created"))
    return out.withColumn("revenue", F.round("revenue", 2))


@query("kpi_trend_by_month", """
, m AS (SELECT date_trunc('month', arrival_date)::DATE AS month, sum(room_rate * nights)::DOUBLE AS revenue, sum(nights)::BIGINT AS room_nights,
  (year(date_trunc('month', arrival_date)) * 12 + month(date_trunc('month', arrival_date))) AS k FROM fx_reservations GROUP BY 1, 4)
SELECT m.month::VARCHAR AS month, m.revenue, m.room_nights,
  round(avg(m.revenue) OVER (ORDER BY m.k RANGE BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS revenue_moving_avg,
  round(m.revenue / p.revenue - 1, 6) AS mom_change, round(m.revenue / y.revenue - 1, 6) AS yoy_change
FROM m LEFT JOIN m p ON p.k = m.k - 1 LEFT JOIN m y ON y.k = m.k - 12""", R)
def _(load):
    out = report.kpi_trend(load("fx_reservations"))
    return out.withColumns({
        "revenue_moving_avg": F.round("revenue_moving_avg", 2), "mom_change": F.round("mom_change", 6), "yoy_change": F.round("yoy_change", 6),
    })


@query("adhoc_sql_on_marts", """
SELECT room_type_desc, count(*)::BIGINT AS stays, sum(room_rate)::DOUBLE AS revenue FROM fx_reservations WHERE arrival_date < DATE '1998-01-01' GROUP BY room_type_desc""", R)
def _(load):
    resv = load("fx_reservations")
    readonly.register_marts({"reservations": resv})
    return readonly.run_readonly_sql(resv.sparkSession, """SELECT room_type_desc, count(*) AS stays, sum(room_rate) AS revenue
        FROM datamart_reservations WHERE arrival_date < DATE '1998-01-01' GROUP BY room_type_desc;""")


@query("adhoc_sql_of_all_lines", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity::DOUBLE AS l_quantity FROM lineitem")
def _(load):
    lines = load("lineitem")
    readonly.register_marts({"lines": lines})
    return readonly.run_readonly_sql(lines.sparkSession, "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS l_quantity FROM datamart_lines")


@query("adhoc_sql_as_text", """
, t AS (SELECT nationality, count(*)::BIGINT AS stays FROM fx_reservations GROUP BY nationality)
SELECT nationality || ' | ' || stays::VARCHAR AS line FROM t""", R)
def _(load):
    resv = load("fx_reservations")
    readonly.register_marts({"stays": resv})
    return readonly.render_rows(readonly.run_readonly_sql(
        resv.sparkSession, "SELECT nationality, count(*) AS stays FROM datamart_stays GROUP BY nationality"
    ))
