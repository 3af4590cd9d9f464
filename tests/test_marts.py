from __future__ import annotations

import random
from collections import defaultdict
from decimal import Decimal

from pyspark.sql import functions as F

from hotelspark.operators import mart
from hotelspark.operators.mart import build_mart, latest_by_key

SCHEMA = "k string, csv_upload_id int, id int, version bigint, v string, w string, deleted_at string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_values_skip_nulls_in_both_stages(spark):
    df = spark.createDataFrame([
        ("a", 1, 1, 10, "old", "w1", None), ("a", 1, 2, 20, None, "w2", None),   # newest version without v
        ("a", 2, 3, 30, None, "w3", None),                                        # newest upload without v
    ], SCHEMA)
    row = build_mart(df, ["k"], ["v", "w"]).first()
    assert (row.v, row.w, row.csv_upload_id, row.is_deleted) == ("old", "w3", 2, 0)


def test_same_version_ties_go_to_the_higher_id(spark):
    df = spark.createDataFrame([("a", 1, 1, 10, "one", None, None), ("a", 1, 2, 10, "two", None, None)], SCHEMA)
    assert build_mart(df, ["k"], ["v"]).first().v == "two"


def test_deleted_uploads_lose_to_active_ones(spark):
    df = spark.createDataFrame([
        ("a", 1, 1, 10, "active", None, None), ("a", 2, 2, 20, "gone", "only here", "2024-01-01"),
        ("b", 1, 3, 10, "x", None, "2024-01-01"), ("b", 2, 4, 20, "y", None, "2024-01-02"),
        ("c", 1, 5, 10, "back", None, "2024-01-01"), ("c", 1, 6, 20, "again", None, None),
    ], SCHEMA)
    got = {r.k: r for r in build_mart(df, ["k"], ["v", "w"]).collect()}
    assert (got["a"].v, got["a"].w, got["a"].csv_upload_id, got["a"].is_deleted) == ("active", None, 1, 0)
    assert (got["b"].v, got["b"].is_deleted, got["b"].deleted_at) == ("y", 1, "2024-01-02")
    # A non-null deletion survives a later null inside one upload.
    assert (got["c"].is_deleted, got["c"].v) == (1, "again")


def test_null_keys(spark):
    df = spark.createDataFrame([(None, 1, 1, 1, "x", None, None), ("", 1, 2, 1, "y", None, None)], SCHEMA)
    assert [r.k for r in build_mart(df, ["k"], ["v"]).collect()] == [""]
    assert len(build_mart(df, ["k"], ["v"], null_keys=True).collect()) == 2


def brute_mart(rows, values):
    """The definition, row by row."""
    groups = defaultdict(lambda: defaultdict(list))
    for r in rows:
        if r[0] is not None:
            groups[r[0]][r[1]].append(r)
    out = []
    for key, uploads in groups.items():
        stage1 = {}
        for upload, members in uploads.items():
            members = sorted(members, key=lambda r: (r[3], r[2]))
            last = lambda i: next((m[i] for m in reversed(members) if m[i] is not None), None)  # noqa: E731,B023
            stage1[upload] = {"v": last(4), "w": last(5), "deleted_at": last(6)}
        active = {u: s for u, s in stage1.items() if s["deleted_at"] is None}
        chosen = active or stage1
        pick = lambda c: next((chosen[u][c] for u in sorted(chosen, reverse=True) if chosen[u][c] is not None), None)  # noqa: E731,B023
        out.append((key, max(chosen), *[pick(c) for c in values], pick("deleted_at"), 0 if active else 1))
    return sorted(out, key=repr)


def test_against_brute_force_with_one_hot_key(spark):
    rnd = random.Random(7)
    maybe = lambda x, p: None if rnd.random() < p else x
    rows = [
        ("hot" if rnd.random() < 0.34 else maybe(f"k{rnd.randrange(40)}", 0.05), rnd.randrange(4), i, rnd.randrange(60),
         maybe(f"v{i}", 0.5), maybe(f"w{i}", 0.8), maybe("2024-01-01", 0.9))
        for i in range(3000)
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(build_mart(df, ["k"], ["v", "w"])) == brute_mart(rows, ["v", "w"])
    # Delivering everything twice, in other batches, changes nothing.
    twice = latest_by_key(df.repartition(5).unionByName(df), "id")
    assert rows_of(build_mart(twice, ["k"], ["v", "w"])) == brute_mart(rows, ["v", "w"])


def test_reservation_averages_are_cut_and_zero_without_active_rows(spark):
    df = spark.createDataFrame([
        ("A", "2024-01-01", "2024-01-03", "1", 1, 1, 1, Decimal("10.00"), 2, "FS", None),
        ("A", "2024-01-01", "2024-01-03", "1", 2, 2, 2, Decimal("10.00"), 2, "DX", None),
        ("A", "2024-01-01", "2024-01-03", "1", 3, 3, 3, Decimal("10.02"), 2, None, None),
        ("A", "2024-01-01", "2024-01-03", "1", 4, 4, 4, Decimal("99.00"), 2, None, "2024-02-01"),
        ("B", "2024-01-01", "2024-01-03", "1", 4, 5, 5, Decimal("99.00"), 2, "E", "2024-02-01"),
    ], "guest_name string, arrival_date string, depart_date string, room_number string, csv_upload_id int, id int, version int, "
       "room_rate decimal(18,2), nights int, room_type string, deleted_at string")
    got = {r.guest_name: r for r in mart.mart_reservations(df).collect()}
    assert (got["A"].room_rate, got["A"].total_amount, got["A"].room_type_desc) == (Decimal("10.00"), Decimal("20.01"), "Deluxe")
    assert (got["B"].room_rate, got["B"].total_amount, got["B"].is_deleted) == (Decimal("0.00"), Decimal("0.00"), 1)


def test_latest_by_key_is_deterministic_on_equal_versions(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 4, "z")], "id int, version int, v string")
    assert latest_by_key(df).first().v == latest_by_key(df.orderBy(F.col("v").desc()).coalesce(1)).first().v == "b"
