"""Cleaning jobs and the expressions they are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from hotelspark.functions import dates, hotel, ids, numbers, text
from hotelspark.operators import clean
from hotelspark.workload.aggregates import CATEGORY_SQL, SUBCATEGORY_SQL
from hotelspark.workload.registry import query

S, R, P, C, B = ("fx_stamps",), ("fx_reservations",), ("fx_profiles",), ("fx_chats",), ("fx_bills",)

_AT = "make_timestamp({y}, {m}, {d}, h, mi, s)"
_YMD = "make_timestamp(y, m, d, h, mi, s)"
# Day and month of a day-first text swap whenever the day could be a month.
_MONTH_FIRST = "CASE WHEN d <= 12 THEN make_timestamp(y, d, m, h, mi, s) ELSE make_timestamp(y, m, d, h, mi, s) END"


# The value of each shape of time stamp; the others have none.
_BY_SHAPE = f"""WHEN 0 THEN {_YMD} WHEN 8 THEN {_YMD} WHEN 1 THEN {_YMD} + INTERVAL 7 HOUR WHEN 9 THEN {_YMD} + INTERVAL 7 HOUR
  WHEN 2 THEN {_YMD} - INTERVAL 150 MINUTE WHEN 3 THEN make_timestamp(y, m, d, 0, 0, 0) WHEN 5 THEN make_timestamp(y, m, d, 0, 0, 0)
  WHEN 12 THEN make_timestamp(y, m, d, 0, 0, 0) WHEN 4 THEN {_MONTH_FIRST} WHEN 10 THEN {_MONTH_FIRST}"""


@query("timestamps_normalised", f"""
SELECT id, raw, strftime(CASE fmt {_BY_SHAPE} END, '%Y-%m-%d %H:%M:%S') AS normalised
FROM fx_stamps""", S)
def _(load):
    return load("fx_stamps").select("id", "raw", dates.normalise_timestamp(F.col("raw")).alias("normalised"))


@query("export_dates_parsed", """
SELECT id, raw, CASE WHEN fmt IN (0, 1, 2, 5, 9, 12) THEN make_date(y, m, d) WHEN fmt = 4 THEN make_date(y, m, d)
  WHEN fmt = 3 THEN CASE WHEN d <= 12 THEN make_date(y, d, m) ELSE make_date(y, m, d) END END::VARCHAR AS day
FROM fx_stamps""", S)
def _(load):
    return load("fx_stamps").select("id", "raw", dates.export_date_text(F.col("raw")).alias("day"))


@query("chat_dates_parsed", f"""
SELECT id, raw, CASE fmt WHEN 11 THEN {_YMD} {_BY_SHAPE} END::VARCHAR AS at FROM fx_stamps""", S)
def _(load):
    return load("fx_stamps").select(
        "id", "raw", dates.parse_chat_timestamp(F.col("raw")).alias("at")
    )


_CLOCK = "CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey % 30 AS VARCHAR) || ':' || lpad(CAST(o_orderkey % 70 AS VARCHAR), 2, '0') " \
         "WHEN 1 THEN lpad(CAST(o_orderkey % 30 AS VARCHAR), 2, '0') || lpad(CAST(o_orderkey % 70 AS VARCHAR), 2, '0') WHEN 2 THEN 'late' END"


@query("clock_times", f"""
SELECT o_orderkey AS id, {_CLOCK} AS raw, CASE WHEN o_orderkey % 4 < 2 AND o_orderkey % 30 < 24 AND o_orderkey % 70 < 60
  THEN lpad(CAST(o_orderkey % 30 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_orderkey % 70 AS VARCHAR), 2, '0') END AS hhmm FROM orders""")
def _(load):
    raw = load("orders").select(F.col("o_orderkey").alias("id"), F.expr(_CLOCK.replace("VARCHAR", "STRING")).alias("raw"))
    return raw.select("id", "raw", dates.clock_hhmm(F.col("raw")).alias("hhmm"))


_AMOUNT = "CASE o_orderkey % 4 WHEN 0 THEN 'Rp ' || CAST(o_orderkey AS VARCHAR) || ',000.50' WHEN 1 THEN '(' || CAST(o_orderkey AS VARCHAR) || ')' " \
          "WHEN 2 THEN '-' || CAST(o_orderkey AS VARCHAR) || '.25' ELSE 'free' END"


@query("amounts_parsed", f"""
SELECT o_orderkey AS id, {_AMOUNT} AS raw, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey * 1000 + 0.5 WHEN 1 THEN -o_orderkey WHEN 2 THEN -(o_orderkey + 0.25) END::DOUBLE AS amount,
  CASE o_orderkey % 4 WHEN 0 THEN o_orderkey * 1000 + 0.5 WHEN 1 THEN -o_orderkey WHEN 2 THEN -(o_orderkey + 0.25) END::DOUBLE AS cell_amount,
  CASE o_orderkey % 4 WHEN 0 THEN o_orderkey * 1000 WHEN 1 THEN o_orderkey WHEN 2 THEN -o_orderkey END::BIGINT AS cell_int,
  CASE o_orderkey % 4 WHEN 0 THEN o_orderkey * 100000 + 50 WHEN 1 THEN -o_orderkey * 100 WHEN 2 THEN -(o_orderkey * 100 + 25) END::BIGINT AS cents FROM orders""")
def _(load):
    raw = load("orders").select(F.col("o_orderkey").alias("id"), F.expr(_AMOUNT.replace("VARCHAR", "STRING")).alias("raw"))
    c = F.col("raw")
    return raw.select(
        "id", "raw", numbers.money(c).alias("amount"), numbers.export_amount(c).alias("cell_amount"),
        numbers.export_int(c).alias("cell_int"), numbers.cents(numbers.money(c)).alias("cents"),
    )


@query("amounts_of_many_digits", """
SELECT o_orderkey AS id, CAST(CAST(o_orderkey % 9000 AS VARCHAR) || '000000000000.25' AS DECIMAL(18,2))::DOUBLE AS amount,
  -CAST(CAST(o_orderkey % 9000 AS VARCHAR) || '000000000000.25' AS DECIMAL(18,2))::DOUBLE AS cell_amount FROM orders""")
def _(load):
    raw = F.concat((F.col("o_orderkey") % 9000).cast("string"), F.lit("000000000000.25"))
    return load("orders").select(F.col("o_orderkey").alias("id"), numbers.money(F.concat(F.lit("Rp "), raw)).alias("amount"),
                                 numbers.export_amount(F.concat(F.lit("("), raw, F.lit(")"))).alias("cell_amount"))


_PHONE = "CASE c_custkey % 6 WHEN 0 THEN '0812-' || CAST(c_custkey AS VARCHAR) WHEN 1 THEN '+62 (81) ' || CAST(c_custkey AS VARCHAR) " \
         "WHEN 2 THEN '62811' || CAST(c_custkey AS VARCHAR) WHEN 3 THEN '812' || CAST(c_custkey AS VARCHAR) WHEN 4 THEN '0' ELSE 'N/A' END"


@query("phones_cleaned", f"""
SELECT c_custkey AS id, {_PHONE} AS raw,
  CASE c_custkey % 6 WHEN 0 THEN '0812' || k WHEN 1 THEN '+6281' || k WHEN 2 THEN '+62811' || k WHEN 3 THEN '812' || k WHEN 4 THEN '0' END AS stay_phone,
  CASE c_custkey % 6 WHEN 0 THEN '+62812' || k WHEN 3 THEN '+62812' || k ELSE '' END AS profile_phone,
  CASE c_custkey % 6 WHEN 0 THEN '812' || k WHEN 1 THEN '+6281' || k WHEN 2 THEN '62811' || k WHEN 3 THEN '812' || k WHEN 4 THEN '0' END AS chat_phone
FROM (SELECT *, CAST(c_custkey AS VARCHAR) AS k FROM customer)""")
def _(load):
    raw = load("customer").select(F.col("c_custkey").alias("id"), F.expr(_PHONE.replace("VARCHAR", "STRING")).alias("raw"))
    c = F.col("raw")
    return raw.select(
        "id", "raw", numbers.stay_phone(c).alias("stay_phone"), numbers.profile_phone(c).alias("profile_phone"),
        numbers.chat_phone(c).alias("chat_phone"),
    )


_BLANK = "CASE o_orderkey % 9 WHEN 0 THEN 'N/A' WHEN 1 THEN 'n/a' WHEN 2 THEN '   ' WHEN 3 THEN NULL WHEN 4 THEN 'None' WHEN 5 THEN 'NULL' WHEN 6 THEN ' nan ' ELSE 'guest' END"


@query("blank_cells", f"""
SELECT o_orderkey AS id, {_BLANK} AS raw, o_orderkey % 9 IN (0, 2, 3, 5) AS blank, o_orderkey % 9 < 7 AS blank_any_case FROM orders""")
def _(load):
    raw = load("orders").select(F.col("o_orderkey").alias("id"), F.expr(_BLANK).alias("raw"))
    c = F.col("raw")
    return raw.select("id", "raw", text.is_blank(c).alias("blank"), text.is_blank_any_case(c).alias("blank_any_case"))


@query("guest_ids_made", """
SELECT r.id, CASE r.id % 4 WHEN 0 THEN r.guest_id
  WHEN 1 THEN 'CUSTOMER_' || substr(guest_name, 10) || '_' || room_number || '_' || strftime(arrival_date, '%Y%m%d')
  WHEN 2 THEN 'CUSTOMER_' || substr(guest_name, 10) || '_' || strftime(arrival_date, '%Y%m%d') || '_' || CAST(r.id AS VARCHAR)
  ELSE 'GUEST_' || CAST(csv_upload_id AS VARCHAR) || '_' || CAST(r.id AS VARCHAR) END AS made FROM fx_reservations r""", R)
def _(load):
    k = F.col("id") % 4
    made = ids.stay_guest_id(
        F.when(k == 0, F.concat(F.col("guest_id"), F.lit(".0"))).otherwise(F.lit("N/A")), F.when(k < 3, F.col("guest_name")),
        F.when(k < 2, F.col("room_number")), F.col("arrival_date").cast("string"), F.col("csv_upload_id"), F.col("id"),
    )
    return load("fx_reservations").select("id", made.alias("made"))


@query("guest_ids_of_long_names", """
SELECT id, repeat('CUSTOMER_' || substr(guest_name, 10) || '_', 5) || room_number || '_' || strftime(arrival_date, '%Y%m%d') AS made FROM fx_reservations""", R)
def _(load):
    long = F.repeat(F.concat("guest_name", F.lit(" ")), 5)
    made = ids.stay_guest_id(F.lit(None).cast("string"), F.trim(long), F.col("room_number"), F.col("arrival_date").cast("string"), F.col("csv_upload_id"), F.col("id"))
    return load("fx_reservations").select("id", made.alias("made"))


@query("room_and_age_labels", """
SELECT id, room_type, CASE WHEN room_type = 'FSX' THEN 'Family Suite' WHEN room_type = 'DLX' THEN 'Deluxe' WHEN room_type IN ('EXE', 'JNR') THEN 'Executive Suite'
  WHEN room_type = 'BZ' THEN 'Suite' ELSE '' END AS described, age::BIGINT AS age,
  CASE WHEN age < 18 THEN 'unidentified' WHEN age < 25 THEN '18-24' WHEN age < 35 THEN '25-34' WHEN age < 45 THEN '35-44' WHEN age < 55 THEN '45-54'
  WHEN age < 65 THEN '55-64' ELSE '65+' END AS age_group FROM fx_reservations""", R)
def _(load):
    return load("fx_reservations").select(
        "id", "room_type", hotel.room_type_desc(F.col("room_type")).alias("described"), "age", hotel.age_group(F.col("age")).alias("age_group")
    )


@query("article_classes", f"""
, n AS (SELECT line_no, outlet AS o, CAST(line_no % 10050 AS BIGINT) AS a, CAST(line_no % 10050 AS VARCHAR) AS t FROM fx_bills)
SELECT line_no, o AS outlet, a AS article_number, {CATEGORY_SQL.format(o='o', a='a')} AS article_category, {SUBCATEGORY_SQL} AS article_subcategory FROM n""", B)
def _(load):
    n = load("fx_bills").select("line_no", "outlet", (F.col("line_no") % 10050).alias("article_number"))
    a, o = F.col("article_number"), F.col("outlet")
    return n.withColumns({"article_category": hotel.article_category(a, o), "article_subcategory": hotel.article_subcategory(a, o)})


@query("guest_names_cleaned", """
SELECT id::BIGINT AS id, name, CASE id % 4 WHEN 0 THEN upper(substr(name, 4)) WHEN 1 THEN upper(substr(name, 9)) || ' FAMILY' ELSE upper(name) END AS profile_name,
  CASE id % 4 WHEN 0 THEN substr(name, 4) WHEN 1 THEN substr(name, 9) || ' Family' ELSE name END AS bill_name FROM fx_profiles""", P)
def _(load):
    c = F.col("name")
    return load("fx_profiles").select(
        "id", "name", text.clean_profile_name(c).alias("profile_name"), text.clean_bill_name(c).alias("bill_name")
    )


@query("occupation_labels", """
SELECT id::BIGINT AS id, occupation, CASE occupation WHEN 'irt' THEN 'IBU RUMAH TANGGA' WHEN 'PNS' THEN 'PEGAWAI NEGERI SIPIL' WHEN 'bumn' THEN 'KARYAWAN BUMN'
  WHEN 'pilot' THEN 'pilot' END AS label FROM fx_profiles""", P)
def _(load):
    return load("fx_profiles").select("id", "occupation", text.occupation_label(F.col("occupation")).alias("label"))


@query("birth_dates_checked", """
SELECT id, raw, CASE WHEN fmt IN (0, 1, 2, 4, 5, 9, 12) AND y BETWEEN 1900 AND 1997 THEN make_date(y, m, d)
  WHEN fmt = 3 AND y BETWEEN 1900 AND 1997 THEN CASE WHEN d <= 12 THEN make_date(y, d, m) ELSE make_date(y, m, d) END END::VARCHAR AS birth_date
FROM fx_stamps""", S)
def _(load):
    return load("fx_stamps").select("id", "raw", dates.sane_birth_date(F.col("raw"), 1997).alias("birth_date"))


@query("cells_scrubbed", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE o_orderpriority || '"' END AS cell FROM orders""")
def _(load):
    raw = F.concat(F.lit('\t "'), F.col("o_orderpriority"), F.lit("\"'\t "))
    tidy = F.concat(F.lit(' "'), F.col("o_orderpriority"), F.lit('"\t'))
    return load("orders").select(F.col("o_orderkey").alias("id"), text.scrub_cell(F.when(F.col("o_orderkey") % 2 == 0, tidy).otherwise(raw)).alias("cell"))


@query("reservations_cleaned", """
SELECT id, CASE WHEN csv_upload_id = 3 THEN 'GUEST_3_' || CAST(id AS VARCHAR) ELSE guest_id END AS guest_id, CASE WHEN csv_upload_id = 3 THEN NULL ELSE upper(guest_name) END AS guest_name,
  strftime(arrival_date, '%Y-%m-%d 00:00:00') AS arrival_date, upper(room_type) AS room_type, upper(segment) AS segment, lower(email) AS email, mobile_phone,
  room_rate::DOUBLE AS room_rate, COALESCE(age, 0)::BIGINT AS age, CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN '' ELSE 'late arrival' END AS remarks, CASE WHEN id % 2 = 0 THEN '14:05' END AS check_in_time
FROM fx_reservations""", R)
def _(load):
    k = F.col("id")
    raw = load("fx_reservations").withColumns({
        "first_name": F.when(F.col("csv_upload_id") != 3, F.col("guest_name")).otherwise("NAN"), "last_name": F.lit("N/A"),
        "guest_id": F.when(F.col("csv_upload_id") != 3, F.concat("guest_id", F.lit(".0"))),
        "arrival_date": F.date_format("arrival_date", "yyyy/MM/dd"), "depart_date": F.date_format("depart_date", "yyyy-MM-dd"),
        "email": F.upper("email"), "mobile_phone": F.regexp_replace("mobile_phone", r"\+62", "62-"), "room_rate": F.col("room_rate").cast("string"),
        "age": F.col("age").cast("string"), "remarks": F.when(k % 3 == 0, "n/a").when(k % 3 == 1, "---").otherwise(" late arrival "),
        "check_in_time": F.when(k % 2 == 0, "1405"), "deleted_at": F.lit(None).cast("string"),
    }).drop("guest_name")
    return clean.standardise_reservations(raw).select(
        "id", "guest_id", "guest_name", "arrival_date", "room_type", "segment", "email", "mobile_phone", "room_rate", "age", "remarks", "check_in_time"
    )


@query("profiles_cleaned", """
SELECT id::BIGINT AS id, guest_id, CASE id % 4 WHEN 0 THEN upper(substr(name, 4)) WHEN 1 THEN upper(substr(name, 9)) || ' FAMILY' ELSE upper(name) END AS name,
  CASE WHEN id % 3 = 0 THEN NULL ELSE lower(email) END AS email, CASE WHEN mobile_no <> '' THEN mobile_no ELSE phone END AS phone,
  CASE occupation WHEN 'irt' THEN 'IBU RUMAH TANGGA' WHEN 'PNS' THEN 'PEGAWAI NEGERI SIPIL' WHEN 'bumn' THEN 'KARYAWAN BUMN' WHEN 'pilot' THEN 'pilot' END AS occupation,
  CASE WHEN segment = 'COMPL' THEN 'COMP' ELSE segment END AS segment, CASE upper(sex) WHEN 'M' THEN 'UNIDENTIFIED' WHEN 'F' THEN 'UNIDENTIFIED' ELSE upper(sex) END AS sex, '0' AS credit_limit
FROM fx_profiles WHERE id % 11 <> 0""", P)
def _(load):
    k = F.col("id")
    raw = load("fx_profiles").withColumns({
        "name": F.when(k % 11 == 0, F.lit("N/A")).otherwise(F.col("name")), "city": F.lit("--"), "address": F.lit("jl. one"),
        "credit_limit": F.lit(" "), "telefax": F.lit("021-55"), "deleted_at": F.lit(None).cast("string"),
    })
    return clean.standardise_profiles(raw).select("id", "guest_id", "name", "email", "phone", "occupation", "segment", "sex", "credit_limit")


@query("chats_cleaned", """
SELECT id, CASE WHEN id % 2 = 0 THEN substr(chats, 2) ELSE substr(chats, 4) END AS phone_number, type AS message_type, strftime(message_date, '%Y-%m-%d 00:00:00') AS message_date
FROM fx_chats WHERE starts_with(chats, '+') AND type IS NOT NULL AND trim(content, chr(9) || ' ') <> ''""", C)
def _(load):
    even = F.col("id") % 2 == 0
    raw = load("fx_chats").select(
        "id", F.lit(1).alias("csv_upload_id"),
        F.when(~F.col("chats").startswith("+"), F.col("chats")).when(even, F.substring("chats", 2, 99)).otherwise(
            F.concat(F.lit("0"), F.substring("chats", 4, 4), F.lit("-"), F.substring("chats", 8, 99))).alias("phone_number"),
        F.concat(F.col("type"), F.lit("\t")).alias("message_type"), F.col("content").alias("message"),
        F.date_format("message_date", "M/d/yyyy").alias("message_date"),
    )
    return clean.standardise_chats(raw).select("id", "phone_number", "message_type", "message_date")


@query("bills_cleaned", """
SELECT line_no AS id, bill_number, strftime(transaction_date, '%Y-%m-%d 00:00:00') AS transaction_date, strftime(transaction_date + INTERVAL 10 HOUR, '%Y-%m-%d %H:%M:%S') AS created_at FROM fx_bills""", B)
def _(load):
    raw = load("fx_bills").select(
        F.col("line_no").alias("id"), "bill_number", F.date_format("transaction_date", "MM/dd/yyyy").alias("transaction_date"),
        F.concat(F.col("transaction_date").cast("string"), F.lit("T03:00:00Z")).alias("created_at"),
    )
    return clean.standardise_resto(raw)


@query("chat_cells_to_rows", """
, x AS (SELECT min(id) AS id, chats, type, name, content, message_date FROM fx_chats WHERE type IS NOT NULL GROUP BY chats, type, name, content, message_date),
names AS (SELECT DISTINCT name FROM x WHERE NOT starts_with(chats, '+'))
SELECT chats AS phone_number, type AS message_type, trim(regexp_replace(content, chr(9), '', 'g'), ' ') AS message, strftime(message_date, '%Y-%m-%d 08:30:00') AS message_date FROM x
WHERE name NOT IN (SELECT name FROM names) AND chats NOT IN (SELECT name FROM names)""", C)
def _(load):
    cells = load("fx_chats").select(
        F.col("chats").alias("phone_number"), F.col("type").alias("message_type"), F.col("name").alias("Name"), F.col("content").alias("message"),
        F.date_format("message_date", "MM-dd-yyyy 08.30.00").alias("message_date"),
    )
    return clean.chat_rows(cells.unionAll(cells)).drop("Name")


@query("bill_cells_to_rows", """
SELECT line_no, bill_number, CASE WHEN line_no % 10 = 0 THEN 0 ELSE article_number END::BIGINT AS article_number, quantity, (sales + 1000)::DOUBLE AS sales,
  CASE WHEN year(transaction_date) >= 1969 THEN transaction_date END::VARCHAR AS transaction_date, 'Tamu Hotel' AS guest_name FROM fx_bills""", B)
def _(load):
    cells = load("fx_bills").select(
        "line_no", F.concat(F.lit(" "), F.col("bill_number").cast("string"), F.lit(".0")).alias("bill_number"),
        F.when(F.col("line_no") % 10 == 0, "?").otherwise(F.col("article_number").cast("string")).alias("article_number"),
        F.col("quantity").cast("string").alias("quantity"), F.format_number((F.col("sales") + 1000).cast("double"), 2).alias("sales"),
        F.date_format("transaction_date", "dd/MM/yy").alias("transaction_date"), F.lit("Hotel, MR Tamu").alias("guest_name"),
    )
    return clean.resto_cells(cells)
