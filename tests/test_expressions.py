from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from hotelspark.functions import dates, hotel, ids, numbers, text


def values(spark, cells, make):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    return [r[0] for r in df.select(make(F.col("c")).alias("x"), "i").orderBy("i").select("x").collect()]


def test_timestamps(spark):
    cases = {
        "2024-01-05 09:08:07": "2024-01-05 09:08:07",
        "2024-1-5": "2024-01-05 00:00:00",
        "05/03/2024": "2024-05-03 00:00:00",       # month first
        "25-03-2024": "2024-03-25 00:00:00",       # only day-first exists
        "05-01-2024": "2024-05-01 00:00:00",       # the year is not an offset
        "2024-01-05 1.02.03": "2024-01-05 01:02:03",
        "2024-01-05T17:00:00Z": "2024-01-06 00:00:00",   # UTC to the hotel's clock
        "2024-01-05T17:00:00.123456+0700": "2024-01-05 17:00:00",
        "2024-01-05 17:00:00+07:00": "2024-01-05 17:00:00",
        "2024-01-05 17:00:00-01": "2024-01-06 01:00:00",
        "2024-02-30": None, "31-31-2024": None, "2024-01-05 25:00:00": None,
        "later": None, "N/A": None, "": None, None: None,
    }
    assert values(spark, list(cases), dates.normalise_timestamp) == list(cases.values())


def test_timestamps_do_not_depend_on_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        # 02:30 does not exist on that day in New York.
        assert values(spark, ["2024-03-10 02:30:00"], dates.normalise_timestamp) == ["2024-03-10 02:30:00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_export_dates(spark):
    cases = {
        "2024-05-01": "2024-05-01", "05/01/2024": "2024-01-05", "05-25-2024": "2024-05-25", "1.2.2024 00:00": "2024-02-01",
        "05/01/24": "2024-01-05", "5 Jan 2024": "2024-01-05", "09-03-1995 12:00:00": "1995-03-09", "x": None,
        "05 January 2024": "2024-01-05", "5-Jan-24": "2024-01-05", "20240105": "2024-01-05", "2024-01-05T10:20:30.123456Z": "2024-01-05",
        "Jan 5, 2024": "2024-01-05", "5 Sept 2024": "2024-09-05", "31 Feb 2024": None, "2024-01-05 10:20:30+09:30": "2024-01-05", "May 2024": None, None: None,
    }
    assert values(spark, list(cases), dates.export_date_text) == list(cases.values())


def test_chat_dates(spark):
    cases = {
        "12-31-2024 10.11.12": "2024-12-31 10:11:12", "31-12-2024 10.11.12": "2024-12-31 10:11:12",
        "31-12-24 10.11.12": "2024-12-31 10:11:12", "01-02-70 10.11.12": "1970-02-01 10:11:12", "soon": None,
    }
    assert values(spark, list(cases), lambda c: dates.parse_chat_timestamp(c).cast("string")) == list(cases.values())


def test_clock(spark):
    cases = {"9:05": "09:05", "23:59": "23:59", "0905": "09:05", "24:00": None, "9.05": None, "14:30:00": None, None: None}
    assert values(spark, list(cases), dates.clock_hhmm) == list(cases.values())


def test_birth_dates(spark):
    assert values(spark, ["1899-12-31", "2031-01-01", "1990-02-03"], lambda c: dates.sane_birth_date(c, 2030)) == [None, None, "1990-02-03"]


def test_money(spark):
    cases = {"1,250,000.00": "1250000.00", "(500)": "-500.00", "Rp 12500000": "12500000.00", "-3.5": "-3.50", "free": None, "": None, "1.2.3": None}
    assert values(spark, list(cases), numbers.money) == [None if v is None else Decimal(v) for v in cases.values()]


def test_large_float_is_not_read_from_exponent_text(spark):
    df = spark.createDataFrame([(12500000.0,)], "c double")
    assert df.select(numbers.money_number(F.col("c"))).first()[0] == Decimal("12500000.00")


def test_ints_and_cents(spark):
    assert values(spark, ["12,7", "1 234", "-", "x", "3.9"], numbers.export_int) == [12, 1234, None, None, 3]
    assert values(spark, ["2.0", " 7 ", "2x", None], numbers.whole_number) == [2, 7, None, None]
    df = spark.createDataFrame([(Decimal("10.005"),), (Decimal("10.015"),)], "c decimal(10,3)")
    assert [r[0] for r in df.select(numbers.cents(F.col("c"))).collect()] == [1000, 1002]


def test_phones(spark):
    cells = ["0812-34", "812 34", "6281234", "+62 812", "0", "N/A", "+62+81"]
    assert values(spark, cells, numbers.stay_phone) == ["081234", "81234", "+6281234", "+62812", "0", None, "+6281"]
    assert values(spark, cells, numbers.profile_phone) == ["+6281234", "+6281234", "", "", "", "", ""]
    assert values(spark, cells, numbers.chat_phone) == ["81234", "81234", "6281234", "+62812", "0", None, None]


def test_blanks(spark):
    cells = ["NAN", "None", "N A", " ", "n/a", "null", "x", None]
    assert values(spark, cells, text.is_blank) == [True, False, True, True, False, True, False, True]
    assert values(spark, cells, text.is_blank_any_case) == [True, True, True, True, True, True, False, True]


def test_names(spark):
    cells = ["Mr. Budi", "Santoso, MRS Ani", "BPK Drs Joko", "a, b, c", "DR, Tini"]
    assert values(spark, cells, text.clean_profile_name) == ["BUDI", "ANI SANTOSO", "DRS JOKO", "A, B, C", "TINI"]
    assert values(spark, ["MR Budi", "Santoso, MRS Ani", "MR. Budi", "a, b, c"], text.clean_bill_name) == [
        "Budi", "Ani Santoso", "MR. Budi", "a, b, c"
    ]


def test_labels(spark):
    assert values(spark, ["irt ", "Peg. Swasta", "pilot ", "", None], text.occupation_label) == [
        "IBU RUMAH TANGGA", "KARYAWAN SWASTA", "pilot", None, None
    ]
    assert values(spark, ["compl", "GIT"], text.segment_label) == ["COMP", "GIT"]
    assert values(spark, ["m", "F", "male", None], text.sex_label) == ["UNIDENTIFIED", "UNIDENTIFIED", "MALE", None]
    assert values(spark, ["n/a", "Nan", "--", " ok ", "NAN", None], text.remark_text) == ["", "", "", "ok", "NAN", None]
    assert values(spark, ["FS1", "d2", "E", "J", "B", "X", "", None], hotel.room_type_desc) == [
        "Family Suite", "Deluxe", "Executive Suite", "Executive Suite", "Suite", "", "", ""
    ]
    assert values(spark, ["17", "18", "64", "65", None], lambda c: hotel.age_group(c.cast("int"))) == [
        "unidentified", "18-24", "55-64", "65+", "65+"
    ]
    assert values(spark, ['\t"a"', "'b'", " \"'c'\" "], text.scrub_cell) == ["a", "b", "c"]


@pytest.mark.parametrize("outlet, number, category, sub", [
    ("Restaurant & Bar", 0, "Others", "Unknown"), ("Restaurant & Bar", 300, "Food", "Main Course"),
    ("Restaurant & Bar", 1005, "Beverages", "Coffee"), ("Restaurant & Bar", 2350, "Others", "Beverages"),
    ("Restaurant & Bar", 3514, "Others", "Others"), ("Restaurant & Bar", 3513, "Others", "Merchandise"),
    ("Restaurant & Bar", 8911, "Others", "Discount"), ("Room Service", 11, "Food", "Others"),
    ("Room Service", 2500, "Beverages", "Bottle"), ("Banquet", 5, "Others", "Lunch"), ("Banquet", 9, "Others", "Other"),
    ("Spa", 1500, "Beverages", "Unknown"), ("", 20000, "Others", "Unknown"),
])
def test_articles(spark, outlet, number, category, sub):
    df = spark.createDataFrame([(outlet, number)], "o string, a bigint")
    row = df.select(hotel.article_category(F.col("a"), F.col("o")), hotel.article_subcategory(F.col("a"), F.col("o"))).first()
    assert tuple(row) == (category, sub)


def test_stay_guest_ids(spark):
    df = spark.createDataFrame([
        (1, "123.0", "A B", "101", "2024-01-05 00:00:00"), (2, "N/A", "A  B-C", "101", "2024-01-05 00:00:00"),
        (3, None, "A B", None, "2024-01-05 00:00:00"), (4, "", None, "1", None), (5, "", "A", None, None),
    ], "id int, g string, n string, r string, a string")
    made = ids.stay_guest_id(F.col("g"), F.col("n"), F.col("r"), F.col("a"), F.lit(9), F.col("id"))
    assert [r[0] for r in df.orderBy("id").select(made).collect()] == [
        "123", "A_B_C_101_20240105", "A_B_20240105_3", "GUEST_9_4", "A_5"
    ]


def test_profile_guest_ids(spark):
    df = spark.createDataFrame([
        (1, "7.0", "A B", "+62812", None, None), (2, "", "A B", "+62-812", "1", "x@y.z"), (3, None, "A B", "", "0812", "x@y.z"),
        (4, None, "A B", "", "", ""), (5, None, "", "", "", ""),
    ], "id int, g string, n string, m string, p string, e string")
    make = lambda fallback: ids.profile_guest_id(
        *[F.col(c) for c in "gnmpe"], F.lit(9), F.col("id"), phone_fallback=fallback
    )
    rows = df.orderBy("id")
    assert [r[0] for r in rows.select(make(False)).collect()] == ["7", "A_B_62_812", "A_B_x_y_z", "A_B_4", "GUEST_9_5"]
    assert rows.select(make(True)).collect()[2][0] == "A_B_0812"


def test_bill_date_is_day_first(spark):
    assert values(spark, ["05/01/24", "31/12/69", "2024-01-05"], dates.parse_short_date) == [date(2024, 1, 5), date(1969, 12, 31), None]
