"""Filters, previews, histories and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from hotelspark.operators import lookups, stays
from hotelspark.workload.registry import query

_STAY = "id, guest_name, arrival_date::VARCHAR AS arrival_date, depart_date::VARCHAR AS depart_date, room_number"
_STAY_COLUMNS = ("id", "guest_name", "arrival_date", "depart_date", "room_number")
R, P, C, B, M = ("fx_reservations",), ("fx_profiles",), ("fx_chats",), ("fx_bills",), ("fx_messages",)


@query("stays_overlap_inclusive", f"""
SELECT {_STAY} FROM fx_reservations WHERE arrival_date <= DATE '1998-03-31' AND depart_date >= DATE '1998-03-01'""", R)
def _(load):
    return stays.overlap_filter(load("fx_reservations"), "1998-03-01", "1998-03-31").select(*_STAY_COLUMNS)


@query("stays_overlap_exclusive", f"""
SELECT {_STAY} FROM fx_reservations WHERE arrival_date < DATE '1998-03-31' AND depart_date > DATE '1998-03-01'""", R)
def _(load):
    return stays.overlap_filter(load("fx_reservations"), "1998-03-01", "1998-03-31", inclusive=False).select(*_STAY_COLUMNS)


@query("stays_filtered_by_dimension", """
SELECT id, segment, room_type_desc, nationality FROM fx_reservations
WHERE segment IN ('BUILDING', 'MACHINERY') AND room_type_desc NOT IN ('Suite')""", R)
def _(load):
    df = stays.dimension_filters(
        load("fx_reservations"), {"segment": " BUILDING, MACHINERY,,", "nationality": ""}, {"room_type_desc": ["Suite"]}
    )
    return df.select("id", "segment", "room_type_desc", "nationality")


@query("numbered_rows_only", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN 'Total' ELSE CAST(o_orderkey AS VARCHAR) END AS number
FROM orders WHERE o_orderkey % 9 <> 0""")
def _(load):
    number = F.when(F.col("o_orderkey") % 9 == 0, F.lit("Total")).otherwise(F.col("o_orderkey").cast("string"))
    return lookups.drop_summary_rows(load("orders").select(F.col("o_orderkey").alias("id"), number.alias("number")), "number")


@query("preview_reservations", "SELECT id, guest_name, room_number FROM fx_reservations ORDER BY id LIMIT 5", R)
def _(load):
    return lookups.preview(load("fx_reservations"), "reservation", 5, 50)


@query("preview_profiles", "SELECT id::BIGINT AS id, name, email FROM fx_profiles ORDER BY id LIMIT 5", P)
def _(load):
    return lookups.preview(load("fx_profiles"), "profile_guest", 5, 50)


@query("preview_chats", """
SELECT id, chats AS phone_number, substr(content, 1, 50) AS message FROM fx_chats ORDER BY id LIMIT 5""", C)
def _(load):
    return lookups.preview(load("fx_chats").withColumnsRenamed({"chats": "phone_number", "content": "message"}), "chat_whatsapp", 5, 50)


@query("preview_bills", """
SELECT line_no AS id, bill_number, description AS guest_name, sales::DOUBLE AS sales FROM fx_bills ORDER BY line_no LIMIT 5""", B)
def _(load):
    return lookups.preview(load("fx_bills").withColumnsRenamed({"line_no": "id", "description": "guest_name"}), "transaction_resto", 5, 50)


@query("stays_in_house", f"""
SELECT {_STAY} FROM fx_reservations WHERE arrival_date <= DATE '1998-03-15' AND depart_date > DATE '1998-03-15'""", R)
def _(load):
    return stays.active_stays(load("fx_reservations"), "1998-03-15").select(*_STAY_COLUMNS)


@query("messages_with_keyword", """
SELECT id, chats, message_date::VARCHAR AS message_date, content FROM fx_chats
WHERE contains(lower(content), 'che') ORDER BY fx_chats.message_date DESC, id DESC LIMIT 100""", C)
def _(load):
    newest = [F.col("message_date").desc(), F.col("id").desc()]
    return lookups.keyword_search(load("fx_chats"), "content", "CHE", newest, 100).select("id", "chats", "message_date", "content")


@query("documents_with_keyword", """
SELECT doc_id, lang, n_chars FROM documents WHERE contains(lower(text), 'the') ORDER BY doc_id DESC LIMIT 100""")
def _(load):
    return lookups.keyword_search(load("documents"), "text", "The", [F.col("doc_id").desc()], 100).select("doc_id", "lang", "n_chars")


@query("stay_history_of_phone", """
SELECT id, mobile_phone, arrival_date::VARCHAR AS arrival_date FROM fx_reservations
WHERE mobile_phone = '+62810007' OR lower(email) = 'customer#000000011@example.com'
ORDER BY fx_reservations.arrival_date DESC, id DESC LIMIT 10""", R)
def _(load):
    df = lookups.history_for(
        load("fx_reservations"), {"mobile_phone": "+62810007", "email": "Customer#000000011@example.com"},
        [F.col("arrival_date").desc(), F.col("id").desc()], 10, ("email",),
    )
    return df.select("id", "mobile_phone", "arrival_date")


@query("profile_of_contact", """
SELECT id::BIGINT AS id, name, phone, mobile_no FROM fx_profiles
WHERE mobile_no = '+62810008' OR phone = '+62810008' OR lower(email) = 'customer#000000010@example.com' ORDER BY id LIMIT 5""", P)
def _(load):
    return lookups.profile_lookup(load("fx_profiles"), "+62810008", "customer#000000010@EXAMPLE.com", 5).select(
        "id", "name", "phone", "mobile_no"
    )


@query("messages_of_session", """
SELECT id, session_id, role FROM fx_messages WHERE session_id = 's7' ORDER BY id LIMIT 50""", M)
def _(load):
    return lookups.history_for(load("fx_messages"), {"session_id": "s7"}, [F.col("id")], 50).select("id", "session_id", "role")


@query("messages_page", "SELECT id, session_id, role FROM fx_messages WHERE id > 20005 ORDER BY id LIMIT 50", M)
def _(load):
    return lookups.page_after(load("fx_messages"), 20005, 50).select("id", "session_id", "role")


@query("uploads_recent", """
SELECT o_orderkey AS id, o_orderpriority AS filename, o_orderdate::DATE::VARCHAR AS created_at FROM orders
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10""")
def _(load):
    ledger = load("orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("filename"), F.col("o_orderdate").cast("date").alias("created_at")
    )
    return lookups.recent_uploads(ledger, 10)
