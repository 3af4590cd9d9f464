"""Hotel-shaped views over generic star-schema tables, for tests and the correctness check.

Each view is one SQL text with ``{table}`` slots, valid unchanged in Spark and DuckDB, so both
engines read exactly the same input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS = {
    "fx_reservations": """
SELECT o_orderkey AS id, CAST(1 + o_custkey % 5 AS INT) AS csv_upload_id,
  o_orderkey % 5000 AS reservation_id, c_name AS guest_name, 'G' || CAST(o_custkey AS STRING) AS guest_id,
  CAST(100 + o_orderkey % 94 AS STRING) AS room_number,
  CASE o_orderkey % 7 WHEN 0 THEN 'FSX' WHEN 1 THEN 'DLX' WHEN 2 THEN 'EXE' WHEN 3 THEN 'JNR' WHEN 4 THEN 'BZ' WHEN 5 THEN 'XX' ELSE NULL END AS room_type,
  CASE o_orderkey % 7 WHEN 0 THEN 'Family Suite' WHEN 1 THEN 'Deluxe' WHEN 2 THEN 'Executive Suite' WHEN 3 THEN 'Executive Suite' WHEN 4 THEN 'Suite' ELSE '' END AS room_type_desc,
  CAST(o_orderdate AS DATE) AS arrival_date,
  CAST(o_orderdate AS DATE) + CAST(1 + o_orderkey % 5 AS INT) AS depart_date,
  CAST(1 + o_orderkey % 5 AS INT) AS nights,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS room_rate,
  CASE WHEN o_custkey % 17 = 0 THEN NULL ELSE CAST(10 + o_custkey % 70 AS INT) END AS age,
  CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS segment,
  n_name AS nationality, CASE WHEN o_custkey % 13 = 0 THEN '' ELSE r_name END AS local_region,
  '+62' || CAST(810000 + o_custkey AS STRING) AS mobile_phone, lower(c_name) || '@example.com' AS email,
  CASE WHEN o_orderstatus = 'P' THEN CAST(o_orderdate AS DATE) + 30 END AS deleted_at, o_orderkey AS version
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
""",
    "fx_versions": """
SELECT user_id, CASE WHEN event_id % 97 = 0 THEN NULL ELSE event_type END AS event_type,
  CAST(event_id % 4 AS INT) AS csv_upload_id, event_id AS id, event_id AS version,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, CASE WHEN event_id % 11 = 0 THEN NULL ELSE props END AS props,
  CASE WHEN event_id % 13 = 0 OR user_id % 10 = 0 THEN ts END AS deleted_at, ts AS ingested_at
FROM {events}
""",
    "fx_room_builds": """
SELECT CAST(s_suppkey AS INT) AS room_build_id, DATE '1995-01-01' + CAST((s_suppkey * 37) % 2400 AS INT) AS built_date,
  CAST(5 + s_suppkey % 60 AS INT) AS room_count,
  CASE s_suppkey % 4 WHEN 0 THEN 'Deluxe' WHEN 1 THEN 'Suite' WHEN 2 THEN 'Executive Suite' ELSE 'Family Suite' END AS room_type_desc
FROM {supplier}
""",
    "fx_profiles": """
SELECT c_custkey AS id, CAST(1 + c_custkey % 5 AS INT) AS csv_upload_id, 'G' || CAST(c_custkey AS STRING) AS guest_id,
  CASE c_custkey % 4 WHEN 0 THEN 'MR ' || c_name WHEN 1 THEN 'Family, ' || c_name ELSE c_name END AS name,
  CASE WHEN c_custkey % 3 = 0 THEN 'N/A' ELSE upper(c_name) || '@EXAMPLE.COM' END AS email,
  '0' || CAST(810000 + c_custkey AS STRING) AS phone,
  CASE WHEN c_custkey % 2 = 0 THEN '+62' || CAST(810000 + c_custkey AS STRING) ELSE '' END AS mobile_no,
  CASE c_custkey % 5 WHEN 0 THEN 'irt' WHEN 1 THEN 'PNS' WHEN 2 THEN 'bumn' WHEN 3 THEN 'pilot' ELSE NULL END AS occupation,
  CASE c_custkey % 3 WHEN 0 THEN 'COMPL' ELSE c_mktsegment END AS segment, n_name AS country, r_name AS local_region,
  CASE c_custkey % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'f' WHEN 2 THEN 'MALE' ELSE NULL END AS sex,
  CAST(DATE '1950-01-01' + CAST(c_custkey % 3000 AS INT) AS STRING) AS birth_date
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
""",
    "fx_bills": """
SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS line_no, l_orderkey AS bill_number,
  CASE WHEN l_linenumber = 7 THEN 8911 WHEN l_linenumber = 6 THEN 9850 ELSE 1 + l_partkey * 2 END AS article_number,
  CASE WHEN l_linenumber = 1 AND l_orderkey % 10 < 3 THEN 'To Table 5 *' || CAST(l_orderkey + 1 AS STRING) ELSE 'Item ' || CAST(l_partkey AS STRING) END AS description,
  CASE l_returnflag WHEN 'R' THEN 'Restaurant & Bar' WHEN 'A' THEN 'Room Service' ELSE 'Banquet' END AS outlet,
  CAST(l_quantity AS BIGINT) AS quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS sales,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS payment, CAST(l_shipdate AS DATE) AS transaction_date
FROM {lineitem}
""",
    "fx_chats": """
SELECT conv_id * 1000 + turn AS id, CASE WHEN conv_id % 5 = 0 THEN 'Staff group' ELSE '+62' || CAST(810000 + conv_id AS STRING) END AS chats,
  CASE role WHEN 'user' THEN 'Received' WHEN 'assistant' THEN 'Sent' ELSE NULL END AS type,
  'P' || CAST(conv_id % 20 AS STRING) AS name, text AS content, DATE '2024-01-01' + CAST(conv_id % 28 AS INT) AS message_date
FROM {conversations}
""",
    "fx_stamps": """
SELECT id, y, m, d, h, mi, s, fmt, CASE fmt
  WHEN 0 THEN yy || '-' || mm || '-' || dd || ' ' || hh || ':' || mimi || ':' || ss
  WHEN 1 THEN yy || '-' || mm || '-' || dd || 'T' || hh || ':' || mimi || ':' || ss || 'Z'
  WHEN 2 THEN yy || '-' || mm || '-' || dd || ' ' || hh || ':' || mimi || ':' || ss || '+09:30'
  WHEN 3 THEN mm || '/' || dd || '/' || yy
  WHEN 4 THEN dd || '-' || mm || '-' || yy || ' ' || hh || ':' || mimi || ':' || ss
  WHEN 5 THEN yy || '-' || CAST(m AS STRING) || '-' || CAST(d AS STRING)
  WHEN 6 THEN 'NaN' WHEN 7 THEN 'no date'
  WHEN 8 THEN yy || '-' || mm || '-' || dd || ' ' || hh || '.' || mimi || '.' || ss
  WHEN 9 THEN yy || '-' || mm || '-' || dd || 'T' || hh || ':' || mimi || ':' || ss || '.123456Z'
  WHEN 10 THEN dd || '-' || mm || '-' || yy || ' ' || hh || '.' || mimi || '.' || ss
  WHEN 11 THEN dd || '-' || mm || '-' || substr(yy, 3, 2) || ' ' || hh || '.' || mimi || '.' || ss
  WHEN 12 THEN yy || '-' || mm || '-' || dd || ' 00:00:00' ELSE NULL END AS raw
FROM (SELECT *, CAST(y AS STRING) AS yy, lpad(CAST(m AS STRING), 2, '0') AS mm, lpad(CAST(d AS STRING), 2, '0') AS dd,
  lpad(CAST(h AS STRING), 2, '0') AS hh, lpad(CAST(mi AS STRING), 2, '0') AS mimi, lpad(CAST(s AS STRING), 2, '0') AS ss
  FROM (SELECT o_orderkey AS id, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, o_orderkey % 24 AS h,
    o_orderkey % 60 AS mi, o_orderkey * 7 % 60 AS s, o_orderkey % 14 AS fmt FROM {orders}) parts) texts
""",
    "fx_messages": """
SELECT conv_id * 1000 + turn AS id, 's' || CAST(conv_id % 40 AS STRING) AS session_id,
  CASE WHEN conv_id % 9 = 0 THEN NULL ELSE 'r' || CAST(conv_id AS STRING) END AS run_id, role, text
FROM {conversations}
""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fixture view as a lazy DataFrame."""
    return spark.sql(VIEWS[name].format(**{t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}))


def ctes(*names: str) -> str:
    """The same views as a WITH list for the DuckDB side."""
    return ",\n".join(f"{n} AS ({VIEWS[n].format(**{t: t for t in TABLES})})" for n in names)
