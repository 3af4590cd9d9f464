"""Soft deletes, purges, merges and rollbacks."""

from __future__ import annotations

from pyspark.sql import functions as F

from hotelspark.operators import contacts, lifecycle, rooms
from hotelspark.workload.registry import query

V, R, RB, P = ("fx_versions",), ("fx_reservations",), ("fx_room_builds",), ("fx_profiles",)
_NOW = "2024-06-01 00:00:00"


def _tables(load):
    versions = load("fx_versions")
    return {"reservation": versions, "profile_guest": versions.filter("user_id % 2 = 0")}


def _ledger(load):
    return load("region").select(
        F.col("r_regionkey").cast("bigint").alias("id"), F.when(F.col("r_regionkey") == 3, "DELETED").otherwise("COMPLETED").alias("status"),
        F.lit(None).cast("timestamp_ntz").alias("deleted_at"),
    )


@query("upload_soft_deleted", f"""
SELECT 'reservation' AS table_name, id, CASE WHEN csv_upload_id = 2 THEN '{_NOW}' ELSE deleted_at::VARCHAR END AS deleted_at FROM fx_versions
UNION ALL SELECT 'profile_guest', id, CASE WHEN csv_upload_id = 2 AND deleted_at IS NULL THEN '{_NOW}' ELSE deleted_at::VARCHAR END FROM fx_versions WHERE user_id % 2 = 0""", V)
def _(load):
    out, _, _ = lifecycle.soft_delete_upload(_tables(load), _ledger(load), 2, F.lit(_NOW).cast("timestamp_ntz"))
    a, b = (df.select(F.lit(n).alias("table_name"), "id", "deleted_at") for n, df in out.items())
    return a.unionByName(b)


@query("upload_soft_delete_counts", """
, c AS (SELECT 'reservation' AS table_name, count(*) AS affected FROM fx_versions WHERE csv_upload_id = 2
  UNION ALL SELECT 'profile_guest', count(*) FROM fx_versions WHERE csv_upload_id = 2 AND user_id % 2 = 0 AND deleted_at IS NULL)
SELECT table_name, affected::BIGINT AS affected FROM c UNION ALL SELECT 'total', sum(affected)::BIGINT FROM c""", V)
def _(load):
    return lifecycle.soft_delete_upload(_tables(load), _ledger(load), 2, F.lit(_NOW).cast("timestamp_ntz"))[2]


@query("upload_soft_delete_ledger", f"""
SELECT r_regionkey::BIGINT AS id, CASE WHEN r_regionkey IN (2, 3) THEN 'DELETED' ELSE 'COMPLETED' END AS status,
  CASE WHEN r_regionkey = 2 THEN '{_NOW}' END AS deleted_at FROM region""")
def _(load):
    return lifecycle.soft_delete_upload(_tables(load), _ledger(load), 2, F.lit(_NOW).cast("timestamp_ntz"))[1]


@query("deleted_rows_purged", """
SELECT 'reservation' AS table_name, id, version, ingested_at::VARCHAR AS ingested_at FROM fx_versions WHERE deleted_at IS NULL
UNION ALL SELECT 'profile_guest', id, version, ingested_at::VARCHAR FROM fx_versions WHERE deleted_at IS NULL AND user_id % 2 = 0""", V)
def _(load):
    kept, _, _ = lifecycle.purge_deleted(_tables(load), _ledger(load))
    parts = [df.select(F.lit(name).alias("table_name"), "id", "version", "ingested_at") for name, df in kept.items()]
    return parts[0].unionByName(parts[1])


@query("purge_counts", """
, c AS (SELECT 'reservation' AS table_name, count(*) AS affected FROM fx_versions WHERE deleted_at IS NOT NULL
  UNION ALL SELECT 'profile_guest', count(*) FROM fx_versions WHERE deleted_at IS NOT NULL AND user_id % 2 = 0
  UNION ALL SELECT 'csv_uploads', count(*) FROM region WHERE r_regionkey = 3)
SELECT table_name, affected::BIGINT AS affected FROM c UNION ALL SELECT 'total', sum(affected)::BIGINT FROM c""", V)
def _(load):
    return lifecycle.purge_deleted(_tables(load), _ledger(load))[2]


def _expiry(load):
    slots = load("events").select(
        "event_id", (F.col("event_id") % 3 == 0).alias("is_active"), F.col("ts").alias("created_at"),
        F.when(F.col("event_id") % 6 == 0, F.col("ts")).alias("consumed_at"),
    )
    return lifecycle.purge_expired(
        slots, F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"), F.col("is_active"), {False: ("created_at", 14400), True: ("consumed_at", 2880)}
    )


_EXPIRED = """
WITH t AS (SELECT event_id, event_id % 3 = 0 AS is_active, ts AS created_at, CASE WHEN event_id % 6 = 0 THEN ts END AS consumed_at FROM events),
e AS (SELECT *, NOT is_active AND created_at < TIMESTAMP '2024-01-25' - INTERVAL 10 DAY AS dead0,
  is_active AND consumed_at IS NOT NULL AND consumed_at < TIMESTAMP '2024-01-25' - INTERVAL 2 DAY AS dead1 FROM t)"""


@query("expired_rows_purged", _EXPIRED + "\nSELECT event_id, is_active FROM e WHERE NOT dead0 AND NOT dead1")
def _(load):
    return _expiry(load)[0].select("event_id", "is_active")


@query("expired_rows_counted", _EXPIRED + """
SELECT count(*) FILTER (WHERE dead0)::BIGINT AS deleted_unconsumed, count(*) FILTER (WHERE dead1)::BIGINT AS deleted_consumed,
  count(*) FILTER (WHERE dead0 OR dead1)::BIGINT AS deleted_total FROM e""")
def _(load):
    return _expiry(load)[1]


@query("processed_rows_merged", """
, t AS (SELECT user_id, event_type, arg_max(id, id) AS id, arg_max(value, id) AS value, arg_max(up, id) AS up FROM (SELECT user_id, event_type, id, COALESCE(value, -1) AS value, csv_upload_id::BIGINT AS up FROM fx_versions WHERE csv_upload_id < 2 AND event_type IS NOT NULL) GROUP BY 1, 2),
b AS (SELECT user_id, event_type, id, COALESCE(value, -1) AS value, csv_upload_id::BIGINT AS up FROM fx_versions WHERE csv_upload_id >= 2),
l AS (SELECT user_id, event_type, arg_max(id, id) AS id, arg_max(value, id) AS value, arg_max(up, id) AS up FROM b WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2)
SELECT COALESCE(l.user_id, t.user_id) AS user_id, COALESCE(l.event_type, t.event_type) AS event_type, COALESCE(l.id, t.id) AS id, COALESCE(l.value, t.value) AS value,
  COALESCE(l.up, t.up) AS last_upload_id FROM t FULL JOIN l ON l.user_id = t.user_id AND l.event_type = t.event_type
UNION ALL SELECT user_id, event_type, id, value, up FROM b WHERE user_id IS NULL OR event_type IS NULL""", V)
def _(load):
    rows = load("fx_versions").select(
        "user_id", "event_type", "id", F.coalesce("value", F.lit(-1.0)).alias("value"), F.col("csv_upload_id").cast("bigint").alias("last_upload_id")
    )
    target = rows.filter("last_upload_id < 2 AND event_type IS NOT NULL").groupBy("user_id", "event_type").agg(
        F.max(F.struct("id", "value", "last_upload_id")).alias("r")
    ).select("user_id", "event_type", "r.*")
    return lifecycle.upsert_processed(target, rows.filter("last_upload_id >= 2"), ["user_id", "event_type"])


@query("guests_matched", """
, t AS (SELECT id, 'G' || CAST(id AS VARCHAR) AS guest_id, 'N' || CAST(id % 300 AS VARCHAR) AS name, phone, email FROM fx_profiles WHERE id % 3 <> 1),
b AS (SELECT id, 'N' || CAST(id % 400 AS VARCHAR) AS name, CASE WHEN id % 2 = 0 THEN phone ELSE '' END AS phone, email FROM fx_profiles)
SELECT b.id::BIGINT AS id, b.name, COALESCE(
  (SELECT arg_min(t.guest_id, t.id) FROM t WHERE t.name = b.name AND t.phone = b.phone AND b.phone <> ''),
  (SELECT arg_min(t.guest_id, t.id) FROM t WHERE t.name = b.name AND t.email = b.email AND b.email <> ''),
  (SELECT arg_min(t.guest_id, t.id) FROM t WHERE t.name = b.name)) AS matched_guest_id FROM b""", P)
def _(load):
    k = F.col("id")
    profiles = load("fx_profiles")
    target = profiles.filter(k % 3 != 1).withColumn("name", F.concat(F.lit("N"), (k % 300).cast("string")))
    batch = profiles.select(
        "id", F.concat(F.lit("N"), (k % 400).cast("string")).alias("name"), F.when(k % 2 == 0, F.col("phone")).otherwise("").alias("phone"), "email"
    )
    return contacts.match_guest(batch, target).select("id", "name", "matched_guest_id")


_ROLLBACK = """
, raw AS (SELECT guest_id, CAST(id % 4 AS BIGINT) AS csv_upload_id, id, room_rate FROM fx_reservations),
p AS (SELECT guest_id, arg_max(room_rate, csv_upload_id * 100000000000 + id) AS room_rate, max(csv_upload_id) AS last_upload_id FROM raw GROUP BY guest_id),
n AS (SELECT guest_id, arg_max(room_rate, csv_upload_id * 100000000000 + id) AS room_rate, max(csv_upload_id) AS last_upload_id FROM raw WHERE csv_upload_id <> 3 GROUP BY guest_id)"""


def _rollback(load):
    raw = load("fx_reservations").select("guest_id", (F.col("id") % 4).alias("csv_upload_id"), "id", "room_rate")
    processed = raw.groupBy("guest_id").agg(F.max(F.struct("csv_upload_id", "id", "room_rate")).alias("r")).select(
        "guest_id", F.col("r.room_rate").alias("room_rate"), F.col("r.csv_upload_id").alias("last_upload_id")
    )
    return lifecycle.rollback_upload(processed, raw, 3, ["guest_id"])


@query("upload_rolled_back", _ROLLBACK + """
SELECT guest_id, room_rate::DOUBLE AS room_rate, last_upload_id FROM p WHERE last_upload_id <> 3
UNION ALL SELECT n.guest_id, n.room_rate::DOUBLE, n.last_upload_id FROM n JOIN p ON p.guest_id = n.guest_id WHERE p.last_upload_id = 3""", R)
def _(load):
    return _rollback(load)[0]


@query("upload_rollback_counts", _ROLLBACK + """
SELECT count(n.guest_id)::BIGINT AS rolled_back, count(*) FILTER (WHERE n.guest_id IS NULL)::BIGINT AS deleted
FROM p LEFT JOIN n ON n.guest_id = p.guest_id WHERE p.last_upload_id = 3""", R)
def _(load):
    return _rollback(load)[2]


@query("room_builds_updated", """
SELECT room_build_id::BIGINT AS room_build_id, built_date::VARCHAR AS built_date, CASE WHEN room_build_id % 5 = 0 THEN 99 ELSE room_count END::BIGINT AS room_count,
  CASE WHEN room_build_id % 7 = 0 THEN 'Villa' ELSE room_type_desc END AS room_type_desc FROM fx_room_builds
UNION ALL SELECT room_build_id + 1000000000, built_date::VARCHAR, room_count, room_type_desc FROM fx_room_builds WHERE room_build_id % 10 = 3""", RB)
def _(load):
    b, k = load("fx_room_builds"), F.col("room_build_id")
    partial = b.filter((k % 5 == 0) | (k % 7 == 0)).select(
        "room_build_id", F.lit(None).cast("date").alias("built_date"), F.when(k % 5 == 0, 99).alias("room_count"),
        F.when(k % 7 == 0, " Villa ").alias("room_type_desc"),
    )
    new = b.filter(k % 10 == 3).withColumn("room_build_id", (k + 1000000000).cast("int"))
    empty = b.filter(k % 11 == 1).select("room_build_id", *[F.lit(None).cast(t).alias(c) for c, t in b.dtypes if c != "room_build_id"])
    return rooms.upsert_room_builds(b, partial.unionByName(new).unionByName(empty))


@query("room_builds_listed", """
SELECT room_build_id::BIGINT AS room_build_id, built_date::VARCHAR AS built_date, room_count::BIGINT AS room_count, room_type_desc FROM fx_room_builds""", RB)
def _(load):
    return rooms.list_room_builds(load("fx_room_builds"))
