from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hotelspark.operators import clean, contacts, lifecycle, lookups, rooms, sessions
from hotelspark.sources import pages, uploads
from hotelspark.sources.load import load_rows


def test_group_chats_with_missing_names(spark):
    df = spark.createDataFrame([
        (1, "Staff", "Ann"), (2, "+62", "Ann"), (3, "+62", "Bob"), (4, "Ann", "Eve"), (5, None, "Zed"), (6, "+63", "Zed"),
        (7, "+64", None),
    ], "id int, chats string, name string")
    assert {r.id for r in contacts.drop_group_chats(df).collect()} == {3, 7}
    with_null = df.unionByName(spark.createDataFrame([(8, "Group", None)], df.schema))
    assert {r.id for r in contacts.drop_group_chats(with_null).collect()} == {3}


def test_contacts_match_once_per_profile_and_never_on_blanks(spark):
    resv = spark.createDataFrame([(1, "+1", "A@x"), (2, "", ""), (3, "+9", "c@x")], "id int, mobile_phone string, email string")
    prof = spark.createDataFrame([
        (10, "g", "+1", "+1", "a@X"), (11, "g", "", "+1", "b"), (12, "g", "", "", ""), (13, "g", "+7", "+8", "C@X"),
    ], "id int, guest_id string, mobile_no string, phone string, email string")
    got = sorted((r.id, r.profile_id) for r in contacts.link_contacts(resv, prof).fillna(0).collect())
    assert got == [(1, 10), (1, 11), (2, 0), (3, 13)]
    plan = contacts.link_contacts(resv, prof)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and " || " not in plan


def test_best_contact_stays_one_row_per_stay(spark):
    resv = spark.createDataFrame([(i, "+1" if i % 3 else "+2", "x@y") for i in range(300)] + [(900, "", None)], "id int, mobile_phone string, email string")
    prof = spark.createDataFrame([(i, "+1", "+2", "X@Y") for i in range(1, 301)], "id int, mobile_no string, phone string, email string")
    rows = {r.id: r for r in contacts.best_contact(resv, prof).collect()}
    assert len(rows) == 301
    assert (rows[1].profile_id, rows[1].mobile_matches, rows[1].phone_matches, rows[1].email_matches) == (1, 300, 0, 300)
    assert (rows[3].profile_id, rows[3].mobile_matches, rows[3].phone_matches) == (1, 0, 300)
    assert (rows[900].profile_id, rows[900].email_matches) == (None, 0)


def test_duplicate_groups_are_rows_not_pairs(spark):
    df = spark.createDataFrame([(i, f"Ann X{i}", "1990-01-01") for i in range(500)] + [(900, "Ann", "1991-01-01")], "id int, name string, birth_date string")
    assert [tuple(r) for r in contacts.duplicate_groups(df).collect()] == [("1990-01-01", "ANN", 500, 0, 499)]


def test_footer_rows(spark):
    df = spark.createDataFrame([("1",), (" 2.0 ",), ("Total",), (None,)], "Number string")
    assert lookups.drop_summary_rows(df).count() == 2


def test_previews(spark):
    df = spark.createDataFrame([(2, "a", "b", "1"), (1, None, "b", "1")], "id int, first_name string, last_name string, room_number string")
    assert [tuple(r) for r in lookups.preview(df, "reservation", 5, 50).collect()] == [(1, None, "1"), (2, "a b", "1")]
    with pytest.raises(ValueError):
        lookups.preview(df, "other", 5, 50)


def test_pages_have_a_default_size(spark):
    df = spark.range(1, 200)
    with pytest.raises(ValueError):
        lookups.page_after(df, 100, 0)
    assert [r.id for r in lookups.page_after(df, 197, 5).collect()] == [198, 199]


def test_room_build_changes(spark):
    ddl = "room_build_id int, built_date string, room_count int, room_type_desc string"
    old = spark.createDataFrame([(1, "2024-01-01", 5, "Deluxe"), (2, "2024-01-01", 6, "Suite")], ddl)
    new = spark.createDataFrame([(1, None, 9, None), (2, None, None, None), (3, "2024-02-01", 1, " Villa ")], ddl)
    assert sorted(tuple(r) for r in rooms.upsert_room_builds(old, new).collect()) == [
        (1, "2024-01-01", 9, "Deluxe"), (2, "2024-01-01", 6, "Suite"), (3, "2024-02-01", 1, "Villa")
    ]


def test_deleting_a_deleted_upload_changes_nothing(spark):
    rows = spark.createDataFrame([(1, 7, None), (2, 7, "2024-01-01")], "id int, csv_upload_id int, deleted_at string")
    ledger = spark.createDataFrame([(7, "DELETED", "2024-01-01")], "id int, status string, deleted_at string")
    out, led, counts = lifecycle.soft_delete_upload({"reservation": rows}, ledger, 7, F.lit("2025-01-01"))
    assert {r.deleted_at for r in out["reservation"].collect()} == {None, "2024-01-01"}
    assert led.first().deleted_at == "2024-01-01" and {r.affected for r in counts.collect()} == {0}
    out, led, counts = lifecycle.soft_delete_upload({"reservation": rows, "chat": rows}, ledger.withColumn("status", F.lit("COMPLETED")), 7, F.lit("2025-01-01"))
    assert {r.deleted_at for r in out["reservation"].collect()} == {"2025-01-01"}
    assert {r.deleted_at for r in out["chat"].collect()} == {"2025-01-01", "2024-01-01"}
    assert {r.table_name: r.affected for r in counts.collect()} == {"reservation": 2, "chat": 1, "total": 3}


def test_rollback(spark):
    raw = spark.createDataFrame([("a", 1, 1, "x"), ("a", 2, 2, "y"), ("b", 2, 3, "z")], "k string, csv_upload_id int, id int, v string")
    processed = spark.createDataFrame([("a", "y", 2), ("b", "z", 2)], "k string, v string, last_upload_id int")
    after, left, counts = lifecycle.rollback_upload(processed, raw, 2, ["k"])
    assert [tuple(r) for r in after.collect()] == [("a", "x", 1)]
    assert left.count() == 1 and tuple(counts.first()) == (1, 1)


def test_upload_verdicts(spark):
    files = spark.createDataFrame([
        ("a.csv", "reservation", b"one"), ("b.CSV", "reservation", b"one"), ("c.csv", "reservation", b"two"), ("d.txt", "reservation", b"3"),
        ("e.csv", "invoice", b"4"), ("f.csv", "reservation", b""), ("g.csv", "reservation", b"\xff\xfe1"), ("h.csv", "reservation", b"gone"),
    ], "filename string, file_type string, content binary")
    import hashlib
    digest = lambda b: hashlib.sha256(b).hexdigest()
    ledger = spark.createDataFrame([(digest(b"two"), "PROCESSING"), (digest(b"gone"), "DELETED")], "file_hash string, status string")
    got = {r.filename: (r.status, r.error_message) for r in uploads.register_uploads(files, ledger).collect()}
    assert [got[k][0] for k in sorted(got)] == ["PROCESSING", "REJECTED", "REJECTED", "REJECTED", "REJECTED", "REJECTED", "REJECTED", "PROCESSING"]
    assert got["g.csv"][1] == "file is not UTF-8" and got["b.CSV"][1] == "content was uploaded before"


def test_page_text(spark):
    html = ("<html><head><title>T</title><style>p{}</style></head><body><!-- no -->\n<script>var a='<b>';</script><p> One  two </p>\n"
            "<p>1 &lt; 2 &amp;amp; caf&#233; &#x41;&nbsp;</p></body></html>")
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    assert pages.html_to_text(df).first().text == "T One two 1 < 2 &amp; café A"
    assert pages.html_to_text(df, limit=5).first().text == "T One..."


def test_transcripts(spark):
    rows = [
        '{"type":"message","role":"assistant","content":[{"type":"output_text","text":"a"},{"type":"image"},{"type":"text","text":"b"}]}',
        '{"type":"message","content":[]}', '{"type":"function_call","name":"q","arguments":"{\\"x\\":1}"}',
        '{"type":"function_call_output","output":"42"}', '{"role":"user","content":"[1] hi"}', "oops",
    ]
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(rows)], "id int, session_id string, message_data string")
    got = [(r.role, r.content) for r in sessions.parse_transcripts(df, order=("id",)).orderBy("id").collect()]
    assert got == [("assistant", "a\nb"), ("assistant", ""), ("tool_call", 'q({"x":1})'), ("tool_output", "42"), ("user", "[1] hi"), (None, "oops")]
    assert sessions.parse_transcripts(df, order=("id",), per_session=2).count() == 2


def test_compact_runs(spark):
    part = lambda t: '{"role":"assistant","content":[{"type":"output_text","text":"%s"}]}' % t
    df = spark.createDataFrame([
        (1, "s", "r", '{"role":"user","content":"Read the conversation now"}'), (2, "s", "r", '{"role":"user","content":"wait..."}'),
        (3, "s", "r", '{"role":"user","content":"[a] real question"}'), (4, "s", "r", '{"role":"user","content":"second"}'),
        (5, "s", "r", part("answer")), (6, "s", "r", part('{\\"insights\\": []}')),
        (7, "s", None, part("loose")), (8, "s", "", '{"role":"user","content":"also loose"}'), (9, "s", "empty", '{"role":"user","content":" "}'),
    ], "id int, session_id string, run_id string, message_data string")
    got = {(r.run_id, r.kind): (r.id, r.content, r.run_order) for r in sessions.compact_runs(df).collect()}
    assert got == {
        ("r", "user_prompt"): (3, "[a] real question", 1), ("r", "assistant_output"): (5, "answer", 1),
        (None, "assistant_output"): (7, "loose", 7), (None, "user_prompt"): (8, "also loose", 7),
    }


def test_similarity(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "u"), (2, [1.0, 1.0], "u"), (3, None, "u"), (4, [0.0, 0.0], "u"), (5, [2.0, 0.0], "w")],
                               "id int, embedding array<float>, user_id string")
    assert [(r.id, r.similarity_score) for r in sessions.similar_top_k(df, [1.0, 0.0], 5, 0.7).collect()] == [(1, 1.0), (5, 1.0), (2, 0.707)]
    assert [r.id for r in sessions.similar_top_k(df, [1.0, 0.0], 1, 0.7, user="u").collect()] == [1]


def test_chat_rows_drop_duplicates_and_undated(spark):
    df = spark.createDataFrame([
        ("+62 1", "Sent", "01-31-2024 10.11.12", "a\tb", "Guest", "f", 1), ("+62 1", "Sent", "01-31-2024 10.11.12", "a\tb", "Guest", "f", 2),
        ("+62 1", None, "01-31-2024 10.11.12", "x", "Guest", "f", 3), ("+62 1", "Sent", "never", "x", "Guest", "f", 4),
    ], "phone_number string, message_type string, message_date string, message string, Name string, source_file string, line_no int")
    rows = clean.chat_rows(df).collect()
    assert [(r.message, str(r.message_date)) for r in rows] == [("ab", "2024-01-31 10:11:12")]


def test_reservation_rows(spark):
    df = spark.createDataFrame([("1", "12.0", "05/01/2024", "1,000.50", "(5)", " x "), ("Total", None, None, None, None, None)],
                               "Number string, reservation_id string, arrival_date string, room_rate string, lodging string, remarks string")
    rows = clean.reservation_rows(df).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.reservation_id, str(r.arrival_date), str(r.room_rate), str(r.lodging), r.remarks) == (12, "2024-01-05", "1000.50", "-5.00", "x")


def test_standardised_profiles(spark):
    df = spark.createDataFrame([
        (1, 9, None, "Santoso, Mr Budi", "--", "0812", " ", "x, y", "Jl. A", None),
        (2, 9, None, " ", "a@b.c", "0812", "0813", "N/A", "--", None),
    ], "id int, csv_upload_id int, guest_id string, name string, email string, phone string, mobile_no string, city string, address string, deleted_at string")
    rows = clean.standardise_profiles(df).collect()
    assert len(rows) == 1
    r = rows[0]
    # The phone is kept but makes no id: only a mobile number does.
    assert (r.name, r.email, r.phone, r.city, r.address, r.guest_id) == ("BUDI SANTOSO", None, "0812", "x, y", "JL. A", "BUDI_SANTOSO_1")


def test_staff_of_one_upload_are_guests_of_another(spark):
    df = spark.createDataFrame([
        (1, "Staff", "Ann", "a.csv"), (2, "+62", "Ann", "a.csv"), (3, "+63", "Ann", "b.csv"), (4, "Ann", "Bob", "b.csv"),
    ], "id int, chats string, name string, source_file string")
    assert {r.id for r in contacts.drop_group_chats(df).collect()} == {3}


def test_one_of_two_files_with_one_name_and_content(spark):
    files = spark.createDataFrame([("a.csv", "reservation", b"one", "/x/a.csv"), ("a.csv", "reservation", b"one", "/y/a.csv")],
                                  "filename string, file_type string, content binary, path string")
    ledger = spark.createDataFrame([], "file_hash string, status string")
    assert sorted(r.status for r in uploads.register_uploads(files, ledger).collect()) == ["PROCESSING", "REJECTED"]
    assert sorted(r.status for r in uploads.register_uploads(files.drop("path"), ledger).collect()) == ["PROCESSING", "REJECTED"]


def test_named_references(spark):
    df = spark.createDataFrame([(1, "<p>Caf&eacute; &pound;5 &unknown; &amp;lt; &lt;b&gt; &#233;</p>")], "page_id int, html string")
    assert pages.html_to_text(df).first().text == "Café £5 &unknown; &lt; <b> é"


def test_rows_of_a_long_session_all_come(spark):
    df = spark.range(700).selectExpr("id", "'s' AS session_id", "id AS created_at", """'{"role": "user", "content": "x"}' AS message_data""")
    assert sessions.parse_transcripts(df).count() == 700


def test_loaded_rows_are_stamped(spark):
    rows = spark.createDataFrame([("/a", 3, "x"), ("/b", 3, "y"), ("/c", 4, "z")], "source_file string, line_no long, name string")
    accepted = spark.createDataFrame([("/a", 1), ("/b", 2)], "path string, csv_upload_id int")
    got = load_rows(rows, accepted, F.lit("2024-01-01").cast("timestamp"))
    assert got.columns == ["id", "csv_upload_id", "line_no", "name", "created_at", "deleted_at"]
    assert {(r.id, r.csv_upload_id, r.name) for r in got.collect()} == {((1 << 32) + 3, 1, "x"), ((2 << 32) + 3, 2, "y")}
