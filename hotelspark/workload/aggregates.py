"""Version resolution, room nights, joins and restaurant bills."""

from __future__ import annotations

from pyspark.sql import functions as F

from hotelspark.operators import bills, contacts, duplicates, lookups, mart, rooms, stays
from hotelspark.schemas import STAY_KEYS
from hotelspark.workload.registry import query, rounded

R, V, RB, P, C, B = (
    ("fx_reservations",), ("fx_versions",), ("fx_room_builds",), ("fx_profiles",), ("fx_chats",), ("fx_bills",)
)


def mart_sql(source: str, keys: str, values: tuple[str, ...], null_keys: bool = False, join: str = "", extra: str = "",
             text: tuple[str, ...] = ()) -> str:
    """Reference form of version resolution: latest per upload, per-key summary, joined back."""
    key_list = [k.strip() for k in keys.split(",")]
    where = "" if null_keys else "WHERE " + " AND ".join(f"{k} IS NOT NULL" for k in key_list)
    same = " AND ".join(f"s.{k} IS NOT DISTINCT FROM g.{k}" for k in key_list)
    s1 = ", ".join(f"arg_max({v}, version) AS {v}" for v in values)
    s2 = ", ".join(
        f"CASE WHEN g.has_active = 1 THEN arg_max(s.{v}, s.csv_upload_id) FILTER (WHERE s.deleted_at IS NULL) "
        f"ELSE arg_max(s.{v}, s.csv_upload_id) END AS {v}"
        for v in ("csv_upload_id", *values, "deleted_at")
    )
    cast = lambda c: f"f.{c}::VARCHAR AS {c}" if c in text else f"f.{c}"
    shown = ", ".join(cast(c) for c in [*key_list, *[v for v in values if v not in ("room_rate",)], "deleted_at"])
    return f"""
, stage1 AS (SELECT {keys}, csv_upload_id, arg_max(id, version) AS id_latest, {s1}, arg_max(deleted_at, version) AS deleted_at
  FROM {source} {where} GROUP BY {keys}, csv_upload_id),
grp AS (SELECT {keys}, max(CASE WHEN deleted_at IS NULL THEN 1 ELSE 0 END) AS has_active FROM stage1 GROUP BY {keys}),
final_rows AS (SELECT {", ".join("s." + k for k in key_list)}, {s2}, 1 - g.has_active AS is_deleted
  FROM stage1 s JOIN grp g ON {same} GROUP BY {", ".join("s." + k for k in key_list)}, g.has_active){join}
SELECT {shown}, f.csv_upload_id::BIGINT AS csv_upload_id, f.is_deleted::BIGINT AS is_deleted{extra} FROM final_rows f"""


_VERSION_VALUES = ("value", "props", "ingested_at", "version")


@query("versions_resolved", mart_sql(
    "fx_versions", "user_id, event_type", _VERSION_VALUES, text=("ingested_at", "deleted_at")), V)
def _(load):
    return mart.build_mart(load("fx_versions"), ["user_id", "event_type"], _VERSION_VALUES)


@query("versions_resolved_null_keys", mart_sql(
    "fx_versions", "user_id, event_type", _VERSION_VALUES, null_keys=True, text=("ingested_at", "deleted_at")), V)
def _(load):
    return mart.build_mart(load("fx_versions"), ["user_id", "event_type"], _VERSION_VALUES, null_keys=True)


_RES_VALUES = ("reservation_id", "guest_id", "room_type", "nights", "room_rate", "age", "segment", "nationality",
               "local_region", "mobile_phone", "email", "version")
# The fixture names stays almost uniquely, so keys are coarsened to a guest and a month to force conflicts.
_COARSE = """
, coarse AS (SELECT id, csv_upload_id, reservation_id, guest_id, CAST(id % 7 AS VARCHAR) AS room_number, room_type,
  'Guest ' || CAST(csv_upload_id + id % 40 AS VARCHAR) AS guest_name, CAST(date_trunc('month', arrival_date) AS DATE) AS arrival_date,
  CAST(date_trunc('month', arrival_date) AS DATE) + CAST(1 + id % 3 AS INT) AS depart_date, nights, room_rate, age, segment,
  nationality, local_region, mobile_phone, email, deleted_at, version FROM fx_reservations)"""


def _coarse(load):
    month = F.trunc("arrival_date", "month")
    return load("fx_reservations").select(
        "id", "csv_upload_id", "reservation_id", "guest_id", (F.col("id") % 7).cast("string").alias("room_number"), "room_type",
        F.concat(F.lit("Guest "), (F.col("csv_upload_id") + F.col("id") % 40).cast("string")).alias("guest_name"),
        month.alias("arrival_date"), F.date_add(month, (1 + F.col("id") % 3).cast("int")).alias("depart_date"), "nights",
        "room_rate", "age", "segment", "nationality", "local_region", "mobile_phone", "email", "deleted_at", "version",
    )


def _cut(total: str, n: str) -> str:
    return f"COALESCE((((CAST({total} * 100 AS HUGEINT)) // {n}) / 100.0)::DOUBLE, 0.0)"


_KEYS = ", ".join(STAY_KEYS)
_RATES = f"""
, rates AS (SELECT {_KEYS}, sum(room_rate) AS r, count(room_rate) AS rn, sum(room_rate * nights) AS t,
  count(room_rate * nights) AS tn FROM stage1 WHERE deleted_at IS NULL GROUP BY {_KEYS})"""
_DESC = """CASE WHEN f.room_type LIKE 'FS%' THEN 'Family Suite' WHEN f.room_type LIKE 'D%' THEN 'Deluxe'
  WHEN f.room_type LIKE 'E%' OR f.room_type LIKE 'J%' THEN 'Executive Suite' WHEN f.room_type LIKE 'B%' THEN 'Suite' ELSE '' END"""


def _mart_reservations_sql(source: str, first: str) -> str:
    body = mart_sql(
        source, _KEYS, _RES_VALUES, join=_RATES, text=("arrival_date", "depart_date", "deleted_at"),
        extra=f", {_DESC} AS room_type_desc, {_cut('a.r', 'a.rn')} AS room_rate, {_cut('a.t', 'a.tn')} AS total_amount",
    ) + f" LEFT JOIN rates a ON {' AND '.join(f'a.{k} = f.{k}' for k in STAY_KEYS)}"
    body = body.replace("f.nights,", "f.nights::BIGINT AS nights,").replace("f.age,", "f.age::BIGINT AS age,")
    return first + body


@query("mart_reservations", _mart_reservations_sql("fx_reservations", ""), R)
def _(load):
    return mart.mart_reservations(load("fx_reservations"))


@query("mart_reservations_conflicts", _mart_reservations_sql("coarse", _COARSE), R)
def _(load):
    return mart.mart_reservations(_coarse(load))


_PROFILE_VALUES = ("email", "phone", "occupation", "country", "segment", "sex", "local_region", "mobile_no", "birth_date",
                   "version", "ingested_at")
_PROFILE_ROWS = """
, rows_p AS (SELECT id, csv_upload_id, 'N' || CAST(id % 200 AS VARCHAR) AS name, CASE WHEN id % 23 = 0 THEN NULL ELSE guest_id_new END AS guest_id,
  email, phone, occupation, country, segment, sex, local_region, mobile_no, birth_date, id AS version,
  DATE '2024-01-01' + CAST(id % 50 AS INT) AS ingested_at, CASE WHEN id % 3 = 0 THEN DATE '2024-02-01' END AS deleted_at
  FROM (SELECT *, 'G' || CAST(id % 200 AS VARCHAR) AS guest_id_new FROM fx_profiles))"""


@query("mart_profiles", _PROFILE_ROWS + mart_sql(
    "rows_p", "name, guest_id", _PROFILE_VALUES, text=("ingested_at", "deleted_at")).replace(
    "f.version,", "f.version::BIGINT AS version,"), P)
def _(load):
    day = lambda base, c: F.date_add(F.lit(base).cast("date"), c.cast("int"))
    i = F.col("id")
    df = load("fx_profiles").select(
        "id", "csv_upload_id", F.concat(F.lit("N"), (i % 200).cast("string")).alias("name"),
        F.when(i % 23 != 0, F.concat(F.lit("G"), (i % 200).cast("string"))).alias("guest_id"),
        "email", "phone", "occupation", "country", "segment", "sex", "local_region", "mobile_no", "birth_date",
        i.alias("version"), day("2024-01-01", i % 50).alias("ingested_at"),
        F.when(i % 3 == 0, F.lit("2024-02-01").cast("date")).alias("deleted_at"),
    )
    return mart.mart_profiles(df)


_CHAT_ROWS = """
, rows_c AS (SELECT id, CAST(id % 3 AS INT) AS csv_upload_id, chats AS phone_number, type AS message_type, message_date,
  content AS message, id AS version, DATE '2024-03-01' + CAST(id % 9 AS INT) AS ingested_at,
  CASE WHEN id % 4 = 0 THEN DATE '2024-04-01' END AS deleted_at FROM fx_chats
  UNION ALL SELECT id + 1000000000, CAST(1 + id % 3 AS INT), chats, type, message_date, content, id + 5, DATE '2024-03-11',
  CASE WHEN id % 5 = 0 THEN DATE '2024-05-01' END FROM fx_chats)"""


@query("mart_chats", _CHAT_ROWS + mart_sql(
    "rows_c", "phone_number, message_type, message_date, message", ("ingested_at", "version"),
    text=("message_date", "ingested_at", "deleted_at")), C)
def _(load):
    i, day = F.col("id"), lambda d: F.lit(d).cast("date")
    chats = load("fx_chats")
    keys = [F.col("chats").alias("phone_number"), F.col("type").alias("message_type"), "message_date",
            F.col("content").alias("message")]
    once = chats.select(
        "id", (i % 3).cast("int").alias("csv_upload_id"), *keys, i.alias("version"),
        F.date_add(day("2024-03-01"), (i % 9).cast("int")).alias("ingested_at"), F.when(i % 4 == 0, day("2024-04-01")).alias("deleted_at"),
    )
    again = chats.select(
        (i + 1000000000).alias("id"), (1 + i % 3).cast("int").alias("csv_upload_id"), *keys, (i + 5).alias("version"),
        day("2024-03-11").alias("ingested_at"), F.when(i % 5 == 0, day("2024-05-01")).alias("deleted_at"),
    )
    return mart.mart_chats(once.unionByName(again))


_RESTO_KEYS = """bill_number, article_number, guest_name, item_name, quantity, sales, payment, article_category, article_subcategory,
  outlet, table_number, posting_id, reservation_number, travel_agent_name, prev_bill_number, transaction_date, start_time,
  close_time, time, bill_discount, bill_compliment, total_deduction"""
_RESTO_ROWS = """
, rows_b AS (SELECT line_no AS id, CAST(line_no % 3 AS INT) AS csv_upload_id, CAST(bill_number AS VARCHAR) AS bill_number,
  CAST(article_number % 5 AS VARCHAR) AS article_number, NULL::VARCHAR AS guest_name, outlet AS item_name, CAST(quantity % 2 AS BIGINT) AS quantity,
  CAST(0 AS BIGINT) AS sales, CAST(0 AS BIGINT) AS payment, 'Food' AS article_category, NULL::VARCHAR AS article_subcategory, outlet,
  CAST(NULL AS BIGINT) AS table_number, NULL::VARCHAR AS posting_id, NULL::VARCHAR AS reservation_number, NULL::VARCHAR AS travel_agent_name,
  CASE WHEN bill_number % 2 = 0 THEN CAST(bill_number AS VARCHAR) END AS prev_bill_number, NULL::DATE AS transaction_date,
  NULL::VARCHAR AS start_time, NULL::VARCHAR AS close_time, NULL::VARCHAR AS time, 0.0::DOUBLE AS bill_discount, 0.0::DOUBLE AS bill_compliment,
  0.0::DOUBLE AS total_deduction, line_no AS version, DATE '2024-01-01' + CAST(line_no % 100 AS INT) AS ingested_at,
  CASE WHEN line_no % 4 = 0 THEN DATE '2024-06-01' + CAST(line_no % 50 AS INT) END AS deleted_at FROM fx_bills)"""


@query("mart_resto", _RESTO_ROWS + mart_sql(
    "rows_b", _RESTO_KEYS, ("ingested_at", "version"), null_keys=True, text=("transaction_date", "ingested_at", "deleted_at")), B)
def _(load):
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("bigint")
    n, bill = F.col("line_no"), F.col("bill_number").cast("string")
    # Two lines may share their number at the smallest scale, so every value follows from the number.
    day = lambda base, c: F.date_add(F.lit(base).cast("date"), c.cast("int"))
    df = load("fx_bills").select(
        n.alias("id"), (n % 3).cast("int").alias("csv_upload_id"), bill.alias("bill_number"),
        (F.col("article_number") % 5).cast("string").alias("article_number"), none.alias("guest_name"), F.col("outlet").alias("item_name"),
        (F.col("quantity") % 2).alias("quantity"), zero.alias("sales"), zero.alias("payment"), F.lit("Food").alias("article_category"),
        none.alias("article_subcategory"), "outlet", F.lit(None).cast("bigint").alias("table_number"), none.alias("posting_id"),
        none.alias("reservation_number"), none.alias("travel_agent_name"),
        F.when(F.col("bill_number") % 2 == 0, bill).alias("prev_bill_number"), F.lit(None).cast("date").alias("transaction_date"),
        none.alias("start_time"), none.alias("close_time"), none.alias("time"),
        *[F.lit(0.0).alias(c) for c in ("bill_discount", "bill_compliment", "total_deduction")], n.alias("version"),
        day("2024-01-01", n % 100).alias("ingested_at"), F.when(n % 4 == 0, day("2024-06-01", n % 50)).alias("deleted_at"),
    )
    return mart.mart_resto(df)


@query("winners_with_rates", f"""
, w AS (SELECT guest_id, max(id) AS id FROM fx_reservations GROUP BY guest_id),
a AS (SELECT guest_id, sum(room_rate) AS s, count(room_rate) AS n FROM fx_reservations WHERE deleted_at IS NULL GROUP BY guest_id)
SELECT w.guest_id, w.id, {_cut('a.s', 'a.n')} AS room_rate FROM w LEFT JOIN a ON a.guest_id = w.guest_id""", R)
def _(load):
    rows = load("fx_reservations")
    winners = rows.groupBy("guest_id").agg(F.max("id").alias("id"))
    return mart.enrich_with_rates(winners, rows, ["guest_id"], ["room_rate"])


@query("stays_linked_to_profiles", """
SELECT r.id, p.id::BIGINT AS profile_id, p.mobile_no AS profile_mobile_no FROM fx_reservations r LEFT JOIN fx_profiles p
ON p.mobile_no = r.mobile_phone OR p.phone = r.mobile_phone OR lower(p.email) = lower(r.email)""", ("fx_reservations", "fx_profiles"))
def _(load):
    return contacts.link_contacts(load("fx_reservations"), load("fx_profiles")).select("id", "profile_id", "profile_mobile_no")


@query("stays_with_best_contact", """
, m AS (SELECT mobile_no AS k, min(id) AS p, count(*) AS n FROM fx_profiles WHERE mobile_no <> '' GROUP BY 1),
t AS (SELECT phone AS k, min(id) AS p, count(*) AS n FROM fx_profiles WHERE phone <> '' GROUP BY 1),
e AS (SELECT lower(email) AS k, min(id) AS p, count(*) AS n FROM fx_profiles WHERE email <> '' GROUP BY 1)
SELECT r.id, COALESCE(m.p, t.p, e.p)::BIGINT AS profile_id, COALESCE(m.n, 0)::BIGINT AS mobile_matches, COALESCE(t.n, 0)::BIGINT AS phone_matches,
  COALESCE(e.n, 0)::BIGINT AS email_matches FROM fx_reservations r LEFT JOIN m ON m.k = r.mobile_phone LEFT JOIN t ON t.k = r.mobile_phone
  LEFT JOIN e ON e.k = lower(r.email)""", ("fx_reservations", "fx_profiles"))
def _(load):
    return contacts.best_contact(load("fx_reservations"), load("fx_profiles")).select(
        "id", "profile_id", "mobile_matches", "phone_matches", "email_matches"
    )


@query("stays_linked_by_guest", """
SELECT r.id, COALESCE((SELECT min(p.id) FROM fx_profiles p WHERE p.guest_id = r.guest_id),
  (SELECT min(p.id) FROM fx_profiles p WHERE p.name = r.guest_name))::BIGINT AS profile_id FROM fx_reservations r""", ("fx_reservations", "fx_profiles"))
def _(load):
    return contacts.link_by_guest(load("fx_reservations"), load("fx_profiles")).select("id", "profile_id")


ROOMS_SQL = """
, days AS (SELECT CAST(unnest(generate_series(TIMESTAMP '{start}', TIMESTAMP '{end}', INTERVAL 1 DAY)) AS DATE) AS day),
latest AS (SELECT d.day, b.room_type_desc, max(b.built_date) AS built FROM days d JOIN fx_room_builds b ON b.built_date <= d.day
  GROUP BY d.day, b.room_type_desc),
rooms AS (SELECT l.day, l.room_type_desc, max(b.room_count)::BIGINT AS room_count FROM latest l JOIN fx_room_builds b
  ON b.room_type_desc = l.room_type_desc AND b.built_date = l.built GROUP BY l.day, l.room_type_desc)"""


@query("rooms_per_day_and_type", ROOMS_SQL.format(start="1996-01-01", end="1998-12-31") + """
SELECT day::VARCHAR AS stay_date, room_type_desc, room_count FROM rooms""", RB)
def _(load):
    return rooms.rooms_as_of(load("fx_room_builds"), "1996-01-01", "1998-12-31")


@query("rooms_on_day", ROOMS_SQL.format(start="1998-03-15", end="1998-03-15") + """
SELECT COALESCE(sum(room_count), 0)::BIGINT AS room_count FROM rooms""", RB)
def _(load):
    return rooms.total_rooms_as_of(load("fx_room_builds"), "1998-03-15")


@query("guest_chats_only", """
, names AS (SELECT DISTINCT name FROM fx_chats WHERE NOT COALESCE(starts_with(chats, '+'), FALSE))
SELECT id, chats, name FROM fx_chats c WHERE NOT EXISTS (SELECT 1 FROM names n WHERE n.name IS NOT DISTINCT FROM c.name)
  AND NOT EXISTS (SELECT 1 FROM names n WHERE n.name IS NOT DISTINCT FROM c.chats)""", C)
def _(load):
    return contacts.drop_group_chats(load("fx_chats")).select("id", "chats", "name")


_EXPAND = """
, x AS (SELECT *, CAST(unnest(generate_series(CAST(greatest(arrival_date, DATE '{s}') AS TIMESTAMP),
  CAST(least(depart_date, DATE '{e}') AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS stay_date
  FROM fx_reservations WHERE arrival_date <= DATE '{e}' AND depart_date >= DATE '{s}')"""


@query("stay_days", _EXPAND.format(s="1997-01-01", e="1997-12-31") + """
SELECT id, stay_date::VARCHAR AS stay_date FROM x""", R)
def _(load):
    return stays.expand_stays(load("fx_reservations"), "1997-01-01", "1997-12-31").select("id", "stay_date")


_AGE = """CASE WHEN age < 18 THEN 'unidentified' WHEN age BETWEEN 18 AND 24 THEN '18-24' WHEN age BETWEEN 25 AND 34 THEN '25-34'
  WHEN age BETWEEN 35 AND 44 THEN '35-44' WHEN age BETWEEN 45 AND 54 THEN '45-54' WHEN age BETWEEN 55 AND 64 THEN '55-64' ELSE '65+' END"""


def key_sql(group_by: str) -> str:
    return {"none": "NULL", "age_group": _AGE}.get(group_by, f"COALESCE({group_by}, 'Unknown')")


def _room_nights_sql(group_by: str, start: str, end: str) -> str:
    measures = """COALESCE(sum(room_rate)::DOUBLE, 0.0) AS revenue_sum, count(*)::BIGINT AS room_sold,
  round(COALESCE(sum(room_rate)::DOUBLE / NULLIF(count(room_rate), 0), 0.0), 4) AS arr_simple,
  count(DISTINCT reservation_id)::BIGINT AS bookings_count"""
    days = f"(date_diff('day', DATE '{start}', DATE '{end}') + 1)::BIGINT AS period_days"
    sql = _EXPAND.format(s=start, e=end) + f", k AS (SELECT *, {key_sql(group_by)} AS gkey FROM x)"
    sql += f"\nSELECT TRUE AS is_total, NULL::VARCHAR AS key, {measures}, {days} FROM k"
    if group_by != "none":
        sql += f"\nUNION ALL SELECT FALSE, gkey, {measures}, {days} FROM k WHERE trim(gkey) <> '' GROUP BY gkey"
    return sql


def _register_room_nights(group_by: str):
    @query(f"room_nights_by_{group_by}" if group_by != "none" else "room_nights_total",
           _room_nights_sql(group_by, "1996-01-01", "1998-12-31"), R)
    def _(load):
        return rounded(stays.room_night_aggregate(load("fx_reservations"), "1996-01-01", "1998-12-31", group_by))


for _g in ("none", "segment", "room_type_desc", "local_region", "nationality", "age_group"):
    _register_room_nights(_g)


@query("nightly_sales_by_type", _EXPAND.format(s="1998-03-01", e="1998-03-31") + """
SELECT stay_date::VARCHAR AS stay_date, room_type_desc, sum(room_rate)::DOUBLE AS revenue_sum, count(*)::BIGINT AS room_sold FROM x
WHERE room_type_desc IS NOT NULL AND nationality <> 'NATION_3' AND segment IN ('BUILDING', 'HOUSEHOLD') GROUP BY x.stay_date, room_type_desc""", R)
def _(load):
    df = stays.dimension_filters(load("fx_reservations"), not_in={"nationality": "NATION_3"})
    return stays.nightly_by_type(df, "1998-03-01", "1998-03-31", {"segment": "BUILDING,HOUSEHOLD"})


def _pro_rata_sql(key: str | None, nights: str) -> str:
    measures = """COALESCE(sum(room_rate * n)::DOUBLE, 0.0) AS revenue_sum, COALESCE(sum(n), 0)::BIGINT AS occupied_room_nights,
  round(COALESCE(sum(room_rate)::DOUBLE / NULLIF(count(room_rate), 0), 0.0), 4) AS arr_simple, count(*)::BIGINT AS bookings_count"""
    sql = f"""
, o AS (SELECT *, {nights} AS n FROM fx_reservations WHERE arrival_date < DATE '1998-03-31' AND depart_date > DATE '1998-03-01')
SELECT TRUE AS is_total, NULL::VARCHAR AS key, {measures} FROM o"""
    return sql if key is None else sql + f"\nUNION ALL SELECT FALSE, {key}, {measures} FROM o GROUP BY {key}"


_INSIDE = """greatest(0, least(date_diff('day', greatest(arrival_date, DATE '1998-03-01'), least(depart_date, DATE '1998-03-31')), nights))"""


@query("pro_rata_nights_by_segment", _pro_rata_sql("COALESCE(NULLIF(segment, ''), 'Unknown')", _INSIDE), R)
def _(load):
    return rounded(stays.overlap_nights_aggregate(load("fx_reservations"), "1998-03-01", "1998-03-31", "segment"))


@query("pro_rata_nights_total_unclipped", _pro_rata_sql(None, "nights"), R)
def _(load):
    return rounded(stays.overlap_nights_aggregate(load("fx_reservations"), "1998-03-01", "1998-03-31", clipped=False))


@query("stay_dimension_values", "\nUNION ALL ".join(
    f"SELECT DISTINCT '{d}' AS dimension, {d} AS value FROM fx_reservations WHERE {d} IS NOT NULL AND {d} <> '' "
    "AND arrival_date <= DATE '1998-03-31' AND depart_date >= DATE '1998-03-01'" for d in stays.DIMENSIONS), R)
def _(load):
    return stays.list_dimensions(load("fx_reservations"), "1998-03-01", "1998-03-31")


@query("stays_merged_from_lines", """
, l AS (SELECT id AS line_no, guest_id AS guest_name, date_trunc('year', arrival_date)::DATE AS arrival_date,
  date_trunc('year', depart_date)::DATE AS depart_date, room_type AS room_number, room_rate, age, segment, local_region FROM fx_reservations)
SELECT guest_name, arrival_date::VARCHAR AS arrival_date, depart_date::VARCHAR AS depart_date, room_number,
  round(sum(room_rate)::DOUBLE / count(room_rate), 3) AS room_rate, arg_min(age, line_no)::BIGINT AS age,
  arg_min(segment, line_no) AS segment, arg_min(local_region, line_no) AS local_region
FROM l WHERE room_number IS NOT NULL GROUP BY guest_name, l.arrival_date, l.depart_date, room_number""", R)
def _(load):
    year = lambda c: F.trunc(c, "year").alias(c)
    lines = load("fx_reservations").select(
        F.col("id").alias("line_no"), F.col("guest_id").alias("guest_name"), year("arrival_date"), year("depart_date"),
        F.col("room_type").alias("room_number"), F.col("room_rate").cast("double").alias("room_rate"), "age", "segment", "local_region",
    )
    return rounded(stays.merge_multi_row_stays(lines), 3)


@query("guests_per_region", "SELECT local_region, count(*)::BIGINT AS guest_count FROM fx_profiles GROUP BY local_region", P)
def _(load):
    return lookups.count_by(load("fx_profiles"), "local_region")


@query("events_per_day", """
SELECT ts::DATE::VARCHAR AS chat_date, count(*)::BIGINT AS message_count FROM events GROUP BY ts::DATE ORDER BY ts::DATE DESC LIMIT 30""")
def _(load):
    return lookups.volume_per_day(load("events"), "ts", 30)


@query("duplicate_guest_groups", """
, w AS (SELECT DISTINCT id, birth_date, unnest(string_split_regex(upper(trim(name)), '[\\s,]+')) AS name_word FROM fx_profiles WHERE birth_date IS NOT NULL)
SELECT birth_date, name_word, count(*)::BIGINT AS guests, min(id)::BIGINT AS first_id, max(id)::BIGINT AS last_id FROM w
WHERE name_word <> '' GROUP BY birth_date, name_word HAVING count(*) > 1""", P)
def _(load):
    return contacts.duplicate_groups(load("fx_profiles"))


_TWO_CHATS = "CASE WHEN starts_with(chats, '+') THEN CAST(1 + id // 1000 % 2 AS INT) ELSE 1 END AS csv_upload_id, 'P' || CAST(id // 1000 % 7 AS VARCHAR) AS name"


# Staff names are seen in the first upload only, so its guests of these names go and those of the second stay.
@query("guest_chats_of_two_uploads", f"""
, c AS (SELECT id, chats, {_TWO_CHATS} FROM fx_chats),
names AS (SELECT DISTINCT csv_upload_id, name FROM c WHERE NOT COALESCE(starts_with(chats, '+'), FALSE))
SELECT id, csv_upload_id::BIGINT AS csv_upload_id, chats, name FROM c
WHERE NOT EXISTS (SELECT 1 FROM names n WHERE n.csv_upload_id = c.csv_upload_id AND (n.name IS NOT DISTINCT FROM c.name OR n.name IS NOT DISTINCT FROM c.chats))""", C)
def _(load):
    chats = load("fx_chats").select("id", "chats", *[F.expr(x) for x in (
        "CASE WHEN startswith(chats, '+') THEN CAST(1 + id div 1000 % 2 AS INT) ELSE 1 END AS csv_upload_id", "'P' || CAST(id div 1000 % 7 AS STRING) AS name")])
    return contacts.drop_group_chats(chats).select("id", "csv_upload_id", "chats", "name")


@query("duplicate_guest_candidates", """
SELECT id::BIGINT AS id, name, birth_date FROM fx_profiles WHERE name LIKE '%Customer%' AND birth_date = '1950-02-03' ORDER BY id LIMIT 20""", P)
def _(load):
    return contacts.duplicate_guests(load("fx_profiles"), "Customer", "1950-02-03", 20).select("id", "name", "birth_date")


# ---- restaurant bills -------------------------------------------------------------------------------------------

MERGED_SQL = r"""
, lines AS (SELECT * FROM fx_bills),
edges AS (SELECT DISTINCT outlet, bill_number AS a, CAST(unnest(regexp_extract_all(description, '(?:To|From)\s+Table\s+\d+\s*\*(\d+)', 1)) AS BIGINT) AS b FROM lines),
both_ways AS (SELECT outlet, a, b FROM edges UNION SELECT outlet, b, a FROM edges),
reach AS (WITH RECURSIVE r AS (SELECT outlet, a AS node, a AS seen FROM both_ways UNION SELECT r.outlet, r.node, e.b FROM r JOIN both_ways e ON e.outlet = r.outlet AND e.a = r.seen)
  SELECT outlet, node, max(seen) AS label FROM r GROUP BY outlet, node),
merged AS (SELECT l.* EXCLUDE (bill_number), COALESCE(x.label, l.bill_number) AS bill_number, l.bill_number AS prev_bill_number
  FROM lines l LEFT JOIN reach x ON x.outlet = l.outlet AND x.node = l.bill_number)"""

_GROUPED = """
, grouped AS (SELECT outlet, bill_number, article_number, sum(quantity)::BIGINT AS quantity, sum(sales) AS sales, sum(payment) AS payment,
  arg_min(description, lpad(line_no::VARCHAR, 25, '0') || description) AS description,
  arg_min(prev_bill_number, lpad(line_no::VARCHAR, 25, '0') || lpad(prev_bill_number::VARCHAR, 20, '0')) AS prev_bill_number,
  arg_max(transaction_date, lpad(line_no::VARCHAR, 25, '0') || transaction_date::VARCHAR) AS transaction_date
  FROM merged GROUP BY outlet, bill_number, article_number),
deducted AS (SELECT outlet, bill_number, COALESCE(sum(sales) FILTER (WHERE CAST(article_number AS VARCHAR) LIKE '891%'), 0) AS bill_discount,
  COALESCE(sum(payment) FILTER (WHERE article_number BETWEEN 9801 AND 9899), 0) AS bill_compliment FROM grouped
  WHERE CAST(article_number AS VARCHAR) LIKE '891%' OR article_number BETWEEN 9801 AND 9899 GROUP BY outlet, bill_number)"""



@query("bills_merged", MERGED_SQL + "\nSELECT line_no, outlet, bill_number, prev_bill_number FROM merged", B)
def _(load):
    return bills.merge_transferred_bills(load("fx_bills")).select("line_no", "outlet", "bill_number", "prev_bill_number")


CATEGORY_SQL = """CASE WHEN {o} = 'Restaurant & Bar' THEN CASE WHEN {a} BETWEEN 1 AND 1000 THEN 'Food' WHEN {a} BETWEEN 1001 AND 2299 THEN 'Beverages' ELSE 'Others' END
  WHEN {o} = 'Room Service' THEN CASE WHEN {a} BETWEEN 1 AND 499 THEN 'Food' WHEN {a} BETWEEN 500 AND 2999 THEN 'Beverages' ELSE 'Others' END
  ELSE 'Others' END"""


SUBCATEGORY_SQL = """CASE
 WHEN o = 'Restaurant & Bar' AND a < 1 THEN 'Unknown'
 WHEN o = 'Restaurant & Bar' AND a <= 40 THEN 'Breakfast' WHEN o = 'Restaurant & Bar' AND a <= 80 THEN 'Appetizer' WHEN o = 'Restaurant & Bar' AND a <= 120 THEN 'Dessert'
 WHEN o = 'Restaurant & Bar' AND a <= 160 THEN 'Pasta' WHEN o = 'Restaurant & Bar' AND a <= 200 THEN 'Extra For Pasta' WHEN o = 'Restaurant & Bar' AND a <= 240 THEN 'Pizza'
 WHEN o = 'Restaurant & Bar' AND a <= 280 THEN 'Easy Bite' WHEN o = 'Restaurant & Bar' AND a <= 1000 THEN 'Main Course'
 WHEN o = 'Restaurant & Bar' AND a <= 2999 THEN CASE WHEN a // 10 = 100 THEN 'Coffee' WHEN a // 10 = 104 THEN 'Tea' WHEN a // 10 = 108 THEN 'Softdrink' WHEN a // 10 = 112 THEN 'Mineral Water'
   WHEN a // 10 = 114 THEN 'Juice' WHEN a // 10 = 118 THEN 'Mocktail' WHEN a // 10 = 122 THEN 'Mixer' WHEN a // 10 = 200 THEN 'Beer' WHEN a // 10 BETWEEN 204 AND 208 THEN 'Cocktail'
   WHEN a // 10 BETWEEN 210 AND 215 THEN 'Shoot' WHEN a // 100 = 22 THEN 'Bottle' ELSE 'Beverages' END
 WHEN o = 'Restaurant & Bar' THEN CASE WHEN starts_with(t, '23') THEN 'Promo' WHEN starts_with(t, '30') THEN 'Cigarette' WHEN starts_with(t, '31') THEN 'Miscellaneous'
   WHEN starts_with(t, '35') AND a NOT IN (3514, 3515, 3516) THEN 'Merchandise' WHEN starts_with(t, '40') THEN 'Soju' WHEN starts_with(t, '69') THEN 'Compliment Cake'
   WHEN starts_with(t, '891') THEN 'Discount' WHEN starts_with(t, '98') THEN 'Compliment' WHEN starts_with(t, '990') THEN 'Cash' WHEN starts_with(t, '991') THEN 'Voucher'
   WHEN starts_with(t, '993') THEN 'Credit Card' WHEN starts_with(t, '995') THEN 'City Ledger' ELSE 'Others' END
 WHEN o = 'Room Service' THEN CASE WHEN a BETWEEN 1 AND 10 THEN 'Dessert' WHEN a BETWEEN 40 AND 49 THEN 'Pasta' WHEN a BETWEEN 121 AND 129 THEN 'Pizza' WHEN a BETWEEN 160 AND 199 THEN 'Snack'
   WHEN a BETWEEN 200 AND 499 THEN 'Main Course' WHEN a BETWEEN 500 AND 599 THEN 'Beer' WHEN a BETWEEN 600 AND 699 THEN 'Cocktail' WHEN a BETWEEN 700 AND 799 THEN 'Canned'
   WHEN a BETWEEN 800 AND 899 THEN 'Water' WHEN a BETWEEN 900 AND 999 THEN 'Coffee' WHEN a BETWEEN 1000 AND 1099 THEN 'Mocktail' WHEN a BETWEEN 1100 AND 1199 THEN 'Tea'
   WHEN a BETWEEN 1200 AND 1299 THEN 'Juice' WHEN a BETWEEN 2000 AND 2999 THEN 'Bottle' WHEN a BETWEEN 3000 AND 3099 THEN 'Promo' ELSE 'Others' END
 WHEN o = 'Banquet' THEN CASE a WHEN 3 THEN 'Room Rental' WHEN 4 THEN 'Coffee Break' WHEN 5 THEN 'Lunch' WHEN 6 THEN 'Dinner' ELSE 'Other' END
 ELSE 'Unknown' END"""


_CONSOLIDATED = MERGED_SQL + _GROUPED + f"""
SELECT g.outlet, g.bill_number, g.article_number::BIGINT AS article_number, g.quantity, g.sales::DOUBLE AS sales, g.payment::DOUBLE AS payment, g.description,
  g.prev_bill_number, g.transaction_date::VARCHAR AS transaction_date, COALESCE(d.bill_discount, 0)::DOUBLE AS bill_discount,
  COALESCE(d.bill_compliment, 0)::DOUBLE AS bill_compliment, (COALESCE(d.bill_discount, 0) + COALESCE(d.bill_compliment, 0))::DOUBLE AS total_deduction,
  {CATEGORY_SQL.format(o='g.outlet', a='g.article_number')} AS article_category,
  (SELECT {SUBCATEGORY_SQL} FROM (SELECT g.outlet AS o, g.article_number AS a, CAST(g.article_number AS VARCHAR) AS t)) AS article_subcategory
FROM grouped g LEFT JOIN deducted d ON d.outlet = g.outlet AND d.bill_number = g.bill_number
WHERE NOT (CAST(article_number AS VARCHAR) LIKE '891%' OR article_number BETWEEN 9801 AND 9899) AND NOT (g.quantity = 0 AND g.sales = 0 AND g.payment = 0)"""


@query("bills_consolidated", _CONSOLIDATED, B)
def _(load):
    return bills.consolidate_bills(load("fx_bills"))


# Two uploads with the same bill numbers, and the second with twice the quantity: nothing is added up across them.
@query("bills_of_two_uploads", _CONSOLIDATED.replace("\nSELECT g.outlet", "\nSELECT u.n AS csv_upload_id, g.outlet").replace(
    "g.quantity, g.sales", "g.quantity * u.n AS quantity, g.sales").replace("FROM grouped g LEFT", "FROM (VALUES (1::BIGINT), (2::BIGINT)) u(n) CROSS JOIN grouped g LEFT"), B)
def _(load):
    lines = load("fx_bills")
    uploads = [lines.withColumns({"csv_upload_id": F.lit(n), "quantity": F.col("quantity") * n}) for n in (1, 2)]
    return bills.consolidate_bills(uploads[0].unionByName(uploads[1]))


@query("bill_deductions", """
, merged AS (SELECT *, bill_number AS prev_bill_number FROM fx_bills)""" + _GROUPED + """
SELECT g.outlet, g.bill_number, g.article_number::BIGINT AS article_number, COALESCE(d.bill_discount, 0)::DOUBLE AS bill_discount,
  COALESCE(d.bill_compliment, 0)::DOUBLE AS bill_compliment, (COALESCE(d.bill_discount, 0) + COALESCE(d.bill_compliment, 0))::DOUBLE AS total_deduction
FROM grouped g LEFT JOIN deducted d ON d.outlet = g.outlet AND d.bill_number = g.bill_number
WHERE NOT (CAST(article_number AS VARCHAR) LIKE '891%' OR article_number BETWEEN 9801 AND 9899) AND NOT (g.quantity = 0 AND g.sales = 0 AND g.payment = 0)""", B)
def _(load):
    return bills.fold_deductions(bills.group_bill_lines(load("fx_bills"))).select(
        "outlet", "bill_number", "article_number", "bill_discount", "bill_compliment", "total_deduction"
    )


@query("bill_totals_on_lines", """
, t AS (SELECT outlet, bill_number, sum(sales) AS bill_sales FROM fx_bills WHERE article_number > 300 GROUP BY outlet, bill_number)
SELECT f.line_no, f.sales::DOUBLE AS sales, t.bill_sales::DOUBLE AS bill_sales FROM fx_bills f
LEFT JOIN t ON t.outlet = f.outlet AND t.bill_number = f.bill_number""", B)
def _(load):
    lines = load("fx_bills")
    totals = lines.filter("article_number > 300").groupBy("outlet", "bill_number").agg(F.sum("sales").alias("bill_sales"))
    return bills.attach_bill_totals(lines, totals).select("line_no", "sales", "bill_sales")


@query("duplicate_guests_similar", """
, g AS (SELECT DISTINCT id, birth_date, trim(regexp_replace(upper(name), '[^A-Z0-9]+', ' ', 'g')) AS n FROM fx_profiles
  WHERE birth_date IS NOT NULL AND id IS NOT NULL),
k AS (SELECT * FROM g WHERE n <> ''),
p AS (SELECT a.id AS u, b.id AS v FROM k a JOIN k b ON a.birth_date = b.birth_date AND a.id <> b.id
  WHERE a.n = b.n OR levenshtein(a.n, b.n) <= 1 OR contains(' ' || b.n || ' ', ' ' || a.n || ' ') OR contains(' ' || a.n || ' ', ' ' || b.n || ' ')),
reach AS (WITH RECURSIVE r AS (SELECT id AS node, id AS seen FROM k UNION SELECT r.node, p.v FROM r JOIN p ON p.u = r.seen)
  SELECT node, min(seen) AS group_id FROM r GROUP BY node),
m AS (SELECT k.id, k.birth_date, reach.group_id FROM k JOIN reach ON reach.node = k.id)
SELECT id::BIGINT AS id, birth_date, group_id::BIGINT AS group_id, count(*) OVER (PARTITION BY group_id)::BIGINT AS guests FROM m
QUALIFY count(*) OVER (PARTITION BY group_id) > 1""", P)
def _(load):
    return duplicates.similar_guests(load("fx_profiles"))
