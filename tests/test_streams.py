from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hotelspark.operators.clean import CLEANERS, profile_rows
from hotelspark.schemas import EVENTS, as_table
from hotelspark.sources.report_csv import read_report_csv
from hotelspark.sources.uploads import read_files
from hotelspark.streaming import cdc, upsert


@pytest.fixture
def folder():
    # A new folder per test, left in place afterwards.
    return Path(tempfile.mkdtemp(prefix="hotelspark-test-"))


def write(path: Path, text: str, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding=encoding)
    return str(path)


def event(op, **after):
    return json.dumps({"after": after, "op": op})


def test_report_with_preamble_and_byte_order_mark(spark, folder):
    head = "Hotel\nGuests\n\nfrom,to\n\n\n"
    a = write(folder / "a.csv", head + 'Guest No, Name ,Mobile  No.,Comments\n1,"Ann, ""A""",0812,"two\nlines"\n,,,\n\n2,Bob,NA,\n', "utf-8-sig")
    b = write(folder / "b.csv", head + "Name,Other\nEve,1\n")
    rows = {r.name: r for r in read_report_csv(spark, [a, "file://" + b], "profile_guest").collect()}
    assert set(rows) == {'Ann, "A"', "Bob", "Eve"}
    ann = rows['Ann, "A"']
    assert (ann.guest_id, ann.mobile_no, ann.comments, ann.email) == ("1", "0812", "two\nlines", None)
    assert rows["Bob"].mobile_no is None and ann.line_no < rows["Bob"].line_no
    clean = {r.name: r for r in profile_rows(read_report_csv(spark, [a], "profile_guest")).collect()}
    assert clean["Bob"].mobile_no is None and clean['Ann, "A'].mobile_no == "+62812"


def test_malformed_reports_are_read_without_quoting(spark, folder):
    path = write(folder / "r.csv", "x\ny\nz\n\n\nNumber,Arrival,Depart,Room Number\n1,a,b,\"1\n2,a,b,2,too,long\n3,c,d,3\nTotal,,,\n")
    rows = read_report_csv(spark, path, "reservation").orderBy("line_no").collect()
    assert [(r.Number, r.room_number) for r in rows] == [("1", '"1'), ("3", "3"), ("Total", None)]


def test_missing_columns_fail_or_are_reported(spark, folder):
    path = write(folder / "c.csv", "Chats,Other\n+62,1\n")
    with pytest.raises(Exception, match="missing required columns"):
        read_report_csv(spark, path, "chat_whatsapp").collect()
    row = read_report_csv(spark, path, "chat_whatsapp", errors="row").first()
    assert "Content" in row["_error"] and row.source_file == path


def test_one_partition_per_file(spark, folder):
    paths = [write(folder / f"{i}.csv", f"Chats,Content,Type,Date,Name\n+{i},x,Sent,d,n\n") for i in range(5)]
    assert read_report_csv(spark, paths, "chat_whatsapp").rdd.getNumPartitions() == 5


def test_uploaded_files_are_listed(spark, folder):
    write(folder / "up" / "x.csv", "a")
    row = read_files(spark, str(folder / "up"), "reservation").first()
    assert (row.filename, row.file_type, bytes(row.content)) == ("x.csv", "reservation", b"a")


CHATS = [
    [event("c", id=1, csv_upload_id=1, phone_number="0812-3", message_type="Sent", message="hi", message_date="2024-01-05T00:00:00Z"),
     event("r", id=2, csv_upload_id=1, phone_number="0812", message_type="Sent", message="snapshot", message_date=None)],
    [event("u", id=1, csv_upload_id=1, phone_number="0812-3", message_type="Sent", message="hello", message_date="2024-01-05T00:00:00Z"),
     event("d", id=3, csv_upload_id=1, phone_number="1", message_type="Sent", message="deleted", message_date=None), "not json"],
    [event("c", id=4, csv_upload_id=2, phone_number="+6281", message_type="Sent", message="new", message_date="05/01/2024")],
]


def test_stream_equals_batch_across_a_restart(spark, folder):
    source, table, checkpoint = str(folder / "in"), str(folder / "table"), str(folder / "cp")

    def run():
        events = cdc.read_cdc(spark, "text", {"path": source, "maxFilesPerTrigger": "1"}, EVENTS["chat_whatsapp"])
        clean = as_table(CLEANERS["chat_whatsapp"](events), "chat_whatsapp")
        upsert.stream_into_table(clean, table, checkpoint, available_now=True).awaitTermination()

    for i, batch in enumerate(CHATS[:2]):
        # The file source goes by modification time.
        os.utime(write(folder / "in" / f"{i}.txt", "\n".join(batch)), (1000 + i, 1000 + i))
    run()
    assert {r.id: r.message for r in upsert.read_latest(spark, table).collect()} == {1: "hello"}
    write(folder / "in" / "2.txt", "\n".join(CHATS[2]))
    run()   # goes on from the checkpoint
    text = F.col("message_date").cast("string").alias("message_date")
    rows = {r.id: r for r in upsert.read_latest(spark, table).select("id", "phone_number", "message", text).collect()}
    whole = as_table(CLEANERS["chat_whatsapp"](cdc.read_cdc(spark, "text", {"path": source}, EVENTS["chat_whatsapp"], stream=False)), "chat_whatsapp")
    assert {(i, r.phone_number, r.message_date) for i, r in rows.items()} == {
        (r.id, r.phone_number, r.message_date) for r in whole.select("id", "phone_number", text).distinct().collect()
    }
    assert {i: r.message for i, r in rows.items()} == {1: "hello", 4: "new"}
    assert (rows[1].phone_number, rows[1].message_date, rows[4].message_date) == ("8123", "2024-01-05 07:00:00", "2024-05-01 00:00:00")


def test_replayed_batches_and_compaction(spark, folder):
    path, smaller = str(folder / "t"), str(folder / "t2")
    frame = lambda rows: spark.createDataFrame(rows, "id int, v string, version bigint")
    upsert.upsert_latest(frame([(1, "a", 1), (1, "b", 2), (2, "x", 5)]), path, 1)
    upsert.upsert_latest(frame([(2, "old", 4), (3, "n", 1)]), path, 2)
    upsert.upsert_latest(frame([(2, "old", 4), (3, "n", 1)]), path, 2)   # delivered again
    want = {(1, "b"), (2, "x"), (3, "n")}
    assert {(r.id, r.v) for r in upsert.read_latest(spark, path).collect()} == want
    assert spark.read.parquet(path).count() == 4
    upsert.compact(spark, path, smaller)
    assert spark.read.parquet(smaller).count() == 3
    upsert.upsert_latest(frame([(1, "c", 2)]), smaller, 3)
    # The later batch wins an equal version.
    assert {(r.id, r.v) for r in upsert.read_latest(spark, smaller).collect()} == {(1, "c"), (2, "x"), (3, "n")}


def test_jobs_write_json_values(spark, folder):
    write(folder / "src" / "0.txt", "\n".join(CHATS[0]))
    write(folder / "bills" / "0.txt", event("c", id=1, csv_upload_id=1, bill_number="7", transaction_date="2024-01-05T00:00:00Z", bill_discount=1.5))
    jobs = {
        "chat_whatsapp": cdc.Job("text", {"path": str(folder / "src")}, "text", {"path": str(folder / "out")}, str(folder / "cp1")),
        "transaction_resto": cdc.Job("text", {"path": str(folder / "bills")}, "text", {"path": str(folder / "out2")}, str(folder / "cp2")),
    }
    cdc.run_jobs(spark, jobs, "chat_whatsapp, transaction_resto", available_now=True)
    out = [json.loads(r.value) for r in spark.read.text(str(folder / "out")).collect()]
    assert out == [{"id": 1, "csv_upload_id": 1, "phone_number": "8123", "message_type": "Sent", "message_date": "2024-01-05 07:00:00", "message": "hi"}]
    bill = json.loads(spark.read.text(str(folder / "out2")).first().value)
    assert bill["transaction_date"] == "2024-01-05 07:00:00" and bill["bill_discount"] == 1.5


def test_a_failing_job_is_raised(spark, folder):
    write(folder / "src" / "0.txt", CHATS[0][0])
    broken = lambda df: df.withColumn("x", F.raise_error(F.lit("broken job")))
    job = cdc.Job("text", {"path": str(folder / "src")}, "text", {"path": str(folder / "o")}, str(folder / "cp"), broken)
    with pytest.raises(Exception, match="broken job"):
        cdc.run_jobs(spark, {"chat_whatsapp": job}, "chat_whatsapp", available_now=True)


def test_job_names():
    assert cdc.chosen_jobs(" ALL ") == list(CLEANERS) == cdc.chosen_jobs("")
    assert cdc.chosen_jobs("chat_whatsapp, reservasi") == ["chat_whatsapp", "reservasi"]
    with pytest.raises(ValueError):
        cdc.chosen_jobs("chat_whatsapp,nothing")
