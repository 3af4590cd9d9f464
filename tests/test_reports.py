from __future__ import annotations

from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from hotelspark.operators import rooms, stays
from hotelspark.plans import report
from hotelspark.plans.sql import check_readonly, describe_result, register_marts, run_readonly_sql

STAYS = ("reservation_id int, arrival_date date, depart_date date, nights int, room_rate decimal(18,2), segment string, "
         "room_type_desc string, local_region string, nationality string, age int")


def d(text):
    return date.fromisoformat(text)


@pytest.fixture(scope="module")
def resv(spark):
    return spark.createDataFrame([
        (1, d("2024-01-01"), d("2024-01-03"), 2, Decimal("100.00"), "A", "Deluxe", "", "ID", 30),
        (2, d("2024-01-02"), d("2024-01-02"), 0, Decimal("50.00"), None, "Suite", "Bali", "ID", None),
        (3, d("2023-12-30"), d("2024-01-01"), 2, Decimal("10.00"), "B", "", "Bali", None, 17),
        (3, d("2024-01-03"), d("2024-01-09"), 6, Decimal("70.00"), "B", "Deluxe", "Java", "SG", 70),
        (4, d("2024-01-05"), d("2024-01-06"), 1, Decimal("999.00"), "A", "Deluxe", "Java", "SG", 40),
    ], STAYS)


@pytest.fixture(scope="module")
def builds(spark):
    return spark.createDataFrame([
        (1, d("2023-01-01"), 5, "Deluxe"), (2, d("2024-01-02"), 8, "Deluxe"), (3, d("2024-01-02"), 6, "Deluxe"),
        (4, d("2024-01-03"), 4, "Suite"), (5, d("2024-02-01"), 50, "Suite"), (6, d("2023-05-05"), 3, "Family Suite"),
    ], "room_build_id int, built_date date, room_count int, room_type_desc string")


def test_departure_day_is_counted(resv):
    got = stays.expand_stays(resv, "2024-01-01", "2024-01-03").groupBy("reservation_id").count().collect()
    assert {r.reservation_id: r["count"] for r in got} == {1: 3, 2: 1, 3: 2}


def test_reversed_stays_give_no_days(spark):
    df = spark.createDataFrame([(1, d("2024-01-03"), d("2024-01-01"), 0, Decimal(1), *["x"] * 4, 1)], STAYS)
    assert stays.expand_stays(df, "2024-01-01", "2024-01-05").count() == 0


def test_room_nights_equal_expanded_rows(resv):
    for key in ("none", "segment", "local_region", "age_group"):
        out = stays.room_night_aggregate(resv, "2024-01-01", "2024-01-06", key).collect()
        total = next(r for r in out if r.is_total)
        assert total.room_sold == stays.expand_stays(resv, "2024-01-01", "2024-01-06").count()
        assert total.bookings_count == 4 and total.period_days == 6
        if key == "segment":
            assert {r.key for r in out if not r.is_total} == {"A", "B", "Unknown"}
        if key == "local_region":
            # The blank region has no row of its own and is not taken for the total.
            assert {r.key for r in out if not r.is_total} == {"Bali", "Java"}


def test_empty_period_gives_a_zero_total(resv, builds):
    one = stays.room_night_aggregate(resv, "2030-01-01", "2030-01-02", "segment").collect()
    assert [(r.is_total, r.room_sold, r.revenue_sum) for r in one] == [(True, 0, 0.0)]
    out = report.occupancy_report(resv, builds, "2030-01-01", "2030-01-02", "room_type_desc").collect()
    assert [(r.is_total, r.room_sold, r.room_count, r.adr_simple) for r in out] == [(True, 0, 2 * (8 + 50 + 3), 0.0)]


def test_rooms_as_of(builds):
    got = {(r.stay_date, r.room_type_desc): r.room_count for r in rooms.rooms_as_of(builds, "2024-01-01", "2024-01-03").collect()}
    assert got == {
        (d("2024-01-01"), "Deluxe"): 5, (d("2024-01-02"), "Deluxe"): 8, (d("2024-01-03"), "Deluxe"): 8,
        (d("2024-01-03"), "Suite"): 4, **{(d(f"2024-01-0{i}"), "Family Suite"): 3 for i in (1, 2, 3)},
    }
    assert rooms.total_rooms_as_of(builds, "2022-01-01").first()[0] == 0


def brute_report(resv_rows, build_rows, start, end, group_by, top_n=None, other=False):
    """The report's rules with plain loops."""
    keys = {"none": lambda r: None, "segment": lambda r: r.segment or "Unknown" if r.segment is None else r.segment,
            "room_type_desc": lambda r: "Unknown" if r.room_type_desc is None else r.room_type_desc,
            "local_region": lambda r: "Unknown" if r.local_region is None else r.local_region}
    days = [start + timedelta(i) for i in range((end - start).days + 1)]
    nights = [(day, r) for r in resv_rows for day in days if r.arrival_date <= day <= r.depart_date]
    groups = {}
    for _, r in nights:
        key = keys[group_by](r)
        if group_by != "none" and key.strip():
            g = groups.setdefault(key, [0, set(), 0.0])
            g[0] += 1
            g[1].add(r.reservation_id)
            g[2] += float(r.room_rate)

    def rooms_on(day):
        latest = {}
        for b in build_rows:
            if b.built_date <= day and (group_by != "room_type_desc" or not groups or b.room_type_desc in groups):
                best = latest.setdefault(b.room_type_desc, (b.built_date, b.room_count))
                latest[b.room_type_desc] = max(best, (b.built_date, b.room_count))
        return {t: n for t, (_, n) in latest.items()}

    div = lambda a, b: a / b if b > 0 else 0.0
    capacity = {day: rooms_on(day) for day in days}
    all_rooms = sum(sum(c.values()) for c in capacity.values())

    def sums(kind):
        occ = adr = 0.0
        for day in days:
            mine = [r for dd, r in nights if dd == day and (kind is None or r.room_type_desc == kind)]
            rooms_ = sum(capacity[day].values()) if kind is None else capacity[day].get(kind, 0)
            occ += div(len(mine), rooms_)
            adr += div(sum(float(r.room_rate) for r in mine), len(mine))
        return occ, adr

    rows = []
    for key, (sold, books, revenue) in groups.items():
        n = sum(c.get(key, 0) for c in capacity.values()) if group_by == "room_type_desc" else all_rooms
        occ, adr = sums(key) if group_by == "room_type_desc" else (div(sold, n), div(revenue, sold))
        rows.append([key, sold, len(books), n, revenue, div(sold, n), occ, div(revenue, sold), adr])
    if top_n and len(rows) > top_n:
        rows.sort(key=lambda x: (-x[4], x[0]))
        head, tail = rows[:top_n], rows[top_n:]
        if other:
            s, b, n, v = (sum(t[i] for t in tail) for i in (1, 2, 3, 4))
            head.append(["Other", s, b, n, v, div(s, n), div(s, n), div(v, s), div(v, s)])
        rows = head
    occ, adr = sums(None)
    if rows:
        s, b, n, v = (sum(t[i] for t in rows) for i in (1, 2, 3, 4))
    else:
        s, b, n, v = len(nights), len({r.reservation_id for _, r in nights}), all_rooms, sum(float(r.room_rate) for _, r in nights)
    rows.append([None, s, b, n, v, div(s, n), occ, div(v, s), adr])
    return {r[0]: pytest.approx(r[1:], abs=1e-9) for r in rows}


@pytest.mark.parametrize("group_by, top_n, other", [
    ("none", None, False), ("segment", None, False), ("local_region", None, False), ("room_type_desc", None, False),
    ("segment", 1, False), ("segment", 2, True), ("room_type_desc", 1, True), ("segment", 9, True),
])
def test_report_rules(resv, builds, group_by, top_n, other):
    got = report.occupancy_report(resv, builds, "2024-01-01", "2024-01-06", group_by, top_n=top_n, include_other=other).collect()
    want = brute_report(resv.collect(), builds.collect(), d("2024-01-01"), d("2024-01-06"), group_by, top_n, other)
    assert {r.key: list(r)[2:] for r in got} == want


def test_corrected_report(resv, builds):
    marked = resv.withColumn("is_deleted", (F.col("reservation_id") == 4).cast("int"))
    got = {r.key: r for r in report.occupancy_report(marked, builds, "2024-01-01", "2024-01-04", "segment", corrected=True).collect()}
    total = got[None]
    # Nights: stay 1 on the 1st and 2nd, the day stay 2, stay 3 (second booking line) on the 3rd and 4th.
    assert (total.room_sold, total.bookings_count, total.room_count) == (5, 3, 8 + 11 + 15 + 15)
    assert total.average_occupancy_rate == pytest.approx((1 / 8 + 2 / 11 + 1 / 15 + 1 / 15) / 4)


def test_comparison_keeps_groups_of_either_period(resv, builds):
    out = {r.key: r for r in report.compare_periods(
        resv, builds, {"start": "2024-01-01", "end": "2024-01-02", "group_by": "segment"}, {"start": "2024-01-05", "end": "2024-01-06"}
    ).collect()}
    assert out["Unknown"].room_sold_a == 1 and out["Unknown"].room_sold_b == 0 and out["Unknown"].room_sold_change == -1


def test_small_measures(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    assert {r.k: r.share_pct for r in report.share_of_total(df, "n").collect()} == {"a": 33.3, "b": 66.7}
    assert {r.share_pct for r in report.share_of_total(df.withColumn("n", F.lit(0)), "n").collect()} == {0.0}
    full = spark.createDataFrame([(500, 2), (3, 2), (3, 0)], "room_sold int, period_days int")
    assert [r.occupancy_pct for r in report.fixed_capacity_occupancy(full, 10).collect()] == [100.0, 15.0, 30.0]
    assert [r.occupancy_pct for r in report.fixed_capacity_occupancy(full, 0).collect()] == [0.0, 0.0, 0.0]


def test_filters_reject_nothing_on_empty_lists(resv):
    assert stays.dimension_filters(resv, {"segment": " , "}, {"segment": None}).count() == 5
    assert stays.split_list(" a, ,b ") == ["a", "b"]
    with pytest.raises(ValueError):
        stays.group_key("city")


def test_readonly_sql(spark, resv):
    register_marts({"stays": resv})
    out = describe_result(run_readonly_sql(spark, "SELECT count(*) AS n FROM datamart_stays;"), 10)
    assert out == {"data": [{"n": 5}], "schema": ["n"], "row_count": 1, "more": False}
    for bad in ("DROP TABLE x", "SELECT 1; DELETE FROM x", "EXPLAIN SELECT 1", "WITH a AS (SELECT 1) SELECT * FROM a"):
        with pytest.raises(ValueError):
            check_readonly(spark, bad)
    assert check_readonly(spark, "WITH a AS (SELECT 1) SELECT * FROM a", allow_with=True)
    resv.createOrReplaceTempView("unpublished")
    for bad in ("SELECT * FROM parquet.`/tmp/x`", "SELECT reflect('java.lang.System', 'exit', 1)", "SELECT * FROM unpublished",
                "SELECT 1 WHERE 1 IN (SELECT id FROM unpublished)", "WITH a AS (SELECT * FROM unpublished) SELECT * FROM a",
                "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "SET a = 1"):
        with pytest.raises(ValueError):
            check_readonly(spark, bad, allow_with=True)
    for good in ("SELECT replace('a', 'a', 'b')", "SELECT * FROM datamart_stays a JOIN (SELECT max(id) AS m FROM datamart_stays) b ON a.id = b.m ORDER BY 1 LIMIT 2",
                 "SELECT 1 UNION ALL SELECT 2", "SELECT DISTINCT segment FROM datamart_stays HAVING count(*) > 1"):
        assert check_readonly(spark, good)


def test_readonly_sql_visits_the_whole_plan(spark):
    wide = ", ".join(f"{i} AS c{i}" for i in range(40))
    for bad in (f"SELECT {wide}, reflect('java.lang.System', 'getProperty', 'user.home') FROM datamart_x",
                "SELECT * FROM datamart_x WHERE 1 IN (SELECT java_method('java.lang.Math', 'abs', -1))",
                "SELECT transform(array(1), v -> try_reflect('java.lang.Math', 'abs', v))",
                "WITH a AS (SELECT reflect('java.lang.Math', 'abs', -1)) SELECT * FROM a",
                "SELECT * FROM (WITH x AS (SELECT 1) SELECT * FROM x) UNION ALL SELECT * FROM x",
                "WITH a AS (SELECT * FROM datamart_x) SELECT * FROM a, unpublished",
                "SELECT * FROM read_files('/tmp')", "SELECT * FROM spark_catalog.default.datamart_x",
                "INSERT INTO datamart_x SELECT 1", "CACHE TABLE datamart_x"):
        with pytest.raises(ValueError):
            check_readonly(spark, bad, allow_with=True)
    for good in ("SELECT 'CTE [a]' AS t", "SELECT 'InsertInto reflect(' AS t FROM datamart_x", "SELECT * FROM DATAMART_X",
                 "VALUES (1)", "SELECT * FROM range(3)", "SELECT * FROM datamart_x LATERAL VIEW explode(array(1)) e AS y",
                 f"SELECT {wide} FROM datamart_x WHERE EXISTS (SELECT 1 FROM datamart_y)"):
        assert check_readonly(spark, good)
    assert check_readonly(spark, "WITH a AS (SELECT 1 AS n), b AS (SELECT * FROM a) SELECT * FROM b JOIN datamart_x", allow_with=True)


def test_plans_have_no_nested_loops_or_python(resv, builds):
    out = report.occupancy_report(resv, builds, "2024-01-01", "2024-01-06", "room_type_desc", top_n=2, include_other=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    for word in ("NestedLoop", "CartesianProduct", "Python"):
        assert word not in plan
