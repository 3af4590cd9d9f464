"""Upload registration, change events, the latest-version table and page text."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hotelspark.schemas import REPORTS
from hotelspark.sources import pages, split_csv, uploads
from hotelspark.sources.load import load_rows
from hotelspark.streaming import cdc, upsert
from hotelspark.session import ensure_checkpoint_dir
from hotelspark.workload.registry import query

_FILES_SQL = """
f AS (SELECT 'doc' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 17 = 0 THEN '.txt' ELSE '.CSV' END AS filename,
  CASE doc_id % 5 WHEN 0 THEN 'profile_guest' WHEN 1 THEN 'reservation' WHEN 2 THEN 'chat_whatsapp' WHEN 3 THEN 'transaction_resto' ELSE 'invoice' END AS file_type,
  CASE WHEN doc_id % 29 = 0 THEN '' ELSE text END AS content FROM documents),
led AS (SELECT sha256(text) AS file_hash, CASE doc_id % 3 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'PROCESSING' ELSE 'FAILED' END AS status FROM documents WHERE doc_id % 7 = 0),
j AS (SELECT filename, file_type, sha256(content) AS file_hash,
  CASE WHEN file_type = 'invoice' THEN 'unsupported file type' WHEN NOT lower(filename) LIKE '%.csv' THEN 'only CSV files are allowed'
       WHEN content = '' THEN 'file is empty' END AS problem FROM f),
k AS (SELECT j.*, CASE WHEN problem IS NULL THEN min(CASE WHEN problem IS NULL THEN filename END) OVER (PARTITION BY file_hash) END AS first_name FROM j)
"""


@query("upload_registration", "WITH " + _FILES_SQL + """
SELECT filename, file_type, file_hash, CASE WHEN e IS NULL THEN 'PROCESSING' ELSE 'REJECTED' END AS status, e AS error_message FROM (
  SELECT *, COALESCE(problem, CASE WHEN file_hash IN (SELECT file_hash FROM led WHERE status IN ('COMPLETED', 'PROCESSING')) OR filename <> first_name
    THEN 'content was uploaded before' END) AS e FROM k)""")
def _(load):
    docs = load("documents")
    i = F.col("doc_id")
    kinds = F.array(*[F.lit(k) for k in (*REPORTS, "invoice")])
    files = docs.select(
        F.concat(F.lit("doc"), i.cast("string"), F.when(i % 17 == 0, ".txt").otherwise(".CSV")).alias("filename"),
        F.element_at(kinds, (i % 5 + 1).cast("int")).alias("file_type"),
        F.when(i % 29 == 0, F.lit("")).otherwise(F.col("text")).alias("content"),
    )
    ledger = docs.filter(i % 7 == 0).select(
        F.sha2("text", 256).alias("file_hash"),
        F.when(i % 3 == 0, "COMPLETED").when(i % 3 == 1, "PROCESSING").otherwise("FAILED").alias("status"),
    )
    return uploads.register_uploads(files, ledger)


@query("upload_closing", """
, led AS (SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'COMPLETED' ELSE 'PROCESSING' END AS status FROM nation),
n AS (SELECT csv_upload_id AS id, count(*) AS c FROM fx_reservations GROUP BY 1)
SELECT led.id, CASE WHEN status = 'PROCESSING' THEN CASE WHEN led.id = 3 OR c IS NULL THEN 'FAILED' ELSE 'COMPLETED' END ELSE status END AS status,
  CASE WHEN status = 'PROCESSING' AND led.id <> 3 AND c IS NOT NULL THEN c ELSE 0 END::BIGINT AS rows_processed,
  CASE WHEN status = 'PROCESSING' THEN CASE WHEN led.id = 3 THEN 'broken header' WHEN c IS NULL THEN 'No valid data rows found after parsing and filtering.' END END AS error_message
FROM led LEFT JOIN n ON n.id = led.id""", ("fx_reservations",))
def _(load):
    key = F.col("n_nationkey").cast("bigint")
    ledger = load("nation").select(
        key.alias("id"), F.when(key % 2 == 0, "COMPLETED").otherwise("PROCESSING").alias("status"),
        F.lit(0).alias("rows_processed"), F.lit(None).cast("string").alias("error_message"),
    )
    failures = load("nation").filter("n_nationkey = 3").select(key.alias("id"), F.lit("broken header").alias("error_message"))
    return uploads.close_uploads(ledger, load("fx_reservations"), failures)


@query("change_events_decoded", """
SELECT event_id AS id, user_id AS csv_upload_id, event_type AS message, ts::VARCHAR AS created_at FROM events WHERE event_id % 4 < 2""")
def _(load):
    op = F.element_at(F.array(*[F.lit(x) for x in "curd"]), (F.col("event_id") % 4 + 1).cast("int"))
    after = F.struct(
        F.col("event_id").alias("id"), F.col("user_id").alias("csv_upload_id"), F.col("event_type").alias("message"),
        F.col("ts").cast("string").alias("created_at"),
    )
    values = load("events").select(F.to_json(F.struct(after.alias("after"), op.alias("op"))).alias("value"))
    return cdc.decode_changes(values, "id bigint, csv_upload_id bigint, message string, created_at string")


@query("rows_as_json_values", """
SELECT '{"c_custkey":' || c_custkey::VARCHAR || ',"c_name":"' || c_name || '","c_mktsegment":"' || c_mktsegment || '"}' AS value FROM customer""")
def _(load):
    return cdc.as_json_values(load("customer").select("c_custkey", "c_name", "c_mktsegment"))


@query("latest_versions", """
SELECT user_id, id, csv_upload_id::BIGINT AS csv_upload_id, version FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY version DESC, csv_upload_id DESC) AS rn FROM (
    SELECT user_id, id, csv_upload_id, CASE WHEN csv_upload_id > 1 THEN version // 2 ELSE version END AS version, id AS tie FROM fx_versions))
WHERE rn = 1""", ("fx_versions",))
def _(load):
    rows = load("fx_versions").select(
        "user_id", "id", "csv_upload_id",
        F.when(F.col("csv_upload_id") > 1, F.expr("version div 2")).otherwise(F.col("version")).alias("version"),
        F.col("ingested_at"),
    )
    out = upsert.upsert_frames(rows.filter("csv_upload_id < 2"), rows.filter("csv_upload_id >= 2"), key="user_id")
    return out.select("user_id", "id", "csv_upload_id", "version")


# RE2 has no back-references, so scripts and styles are removed one after the other.
_PAGE_SQL = r"""
WITH bare AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', '', 'g'),
  '(?is)<style\b.*?</style\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?s)<[!/?a-zA-Z][^>]*>', '', 'g') AS t FROM pages),
decoded AS (SELECT page_id, url, replace(replace(replace(replace(t, '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&') AS t FROM bare),
done AS (SELECT page_id, url, array_to_string(list_filter(list_transform(string_split_regex(t, '\r\n|[\r\n]|  '),
  lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), ' ') AS text FROM decoded)"""


@query("page_texts", _PAGE_SQL + "\nSELECT page_id, url, text FROM done")
def _(load):
    return pages.html_to_text(load("pages"), limit=None)


@query("page_texts_shortened", _PAGE_SQL + """
SELECT page_id, length(text)::BIGINT AS chars, CASE WHEN length(text) > 5000 THEN substr(text, 1, 5000) || '...' ELSE text END AS text FROM done""")
def _(load):
    text = load("pages").select("page_id", pages.page_text(F.col("html"), None).alias("whole"), pages.page_text(F.col("html"), 5000).alias("text"))
    return text.select("page_id", F.length("whole").alias("chars"), "text")


@query("rows_loaded_of_accepted_uploads", """
SELECT (10 + r_regionkey) * 4294967296 + b.ps AS id, (10 + r_regionkey)::BIGINT AS csv_upload_id, b.ps AS line_no, b.name, '2024-01-01 00:00:00' AS created_at
FROM (SELECT c_custkey::BIGINT AS ps, c_name AS name, c_custkey % 5 AS f FROM customer) b JOIN region ON r_regionkey = b.f WHERE r_regionkey < 3""")
def _(load):
    rows = load("customer").select(F.concat(F.lit("/exports/"), (F.col("c_custkey") % 5).cast("string")).alias("source_file"),
                                   F.col("c_custkey").cast("bigint").alias("line_no"), F.col("c_name").alias("name"))
    accepted = load("region").filter("r_regionkey < 3").select(
        F.concat(F.lit("/exports/"), F.col("r_regionkey").cast("string")).alias("path"), (F.col("r_regionkey") + 10).alias("csv_upload_id"))
    return load_rows(rows, accepted, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).drop("deleted_at")


_MISSING_SQL = ", ".join("'" + m.replace("'", "''") + "'" for m in sorted(split_csv.MISSING))


@query("profile_export_ranged", f"""
SELECT * FROM (SELECT
  CASE WHEN CAST(doc_id AS VARCHAR) IN ({_MISSING_SQL}) THEN NULL ELSE CAST(doc_id AS VARCHAR) END AS guest_id,
  CASE WHEN source IN ({_MISSING_SQL}) THEN NULL ELSE source END AS name,
  CASE WHEN lang IN ({_MISSING_SQL}) THEN NULL ELSE lang END AS city,
  CASE WHEN text IN ({_MISSING_SQL}) THEN NULL ELSE text END AS comments FROM documents)
WHERE guest_id IS NOT NULL OR name IS NOT NULL OR city IS NOT NULL OR comments IS NOT NULL""")
def _(load):
    """Every document written as a guest-profile export (multi-line quoted comments) and read back in byte ranges."""
    docs = load("documents")
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/exports-{uuid.uuid4().hex}"
    rows = docs.select(F.col("doc_id").cast("string").alias("Guest No"), F.col("source").alias("Name"),
                       F.col("lang").alias("City"), F.col("text").alias("Comments"))
    preamble = ["Guest profile", "All guests", "", "from,to", "", ""]
    split_csv.write_export(rows, folder, rows.columns, preamble)
    found = split_csv.read_report_csv_ranged(spark, folder, "profile_guest")
    return found.select("guest_id", "name", "city", "comments")
