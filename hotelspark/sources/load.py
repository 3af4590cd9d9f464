"""From parsed exports to raw rows: each row gets the upload it came with, an id and a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of an id that hold the line within its file.
LINE_BITS = 32


def load_rows(rows: DataFrame, accepted: DataFrame, now: Column, line: str = "line_no") -> DataFrame:
    """``rows`` (with ``source_file`` and a line number) of accepted files, stamped for the raw table.

    ``accepted`` has one row (path, csv_upload_id) per upload that was registered as PROCESSING; rows of other files
    do not come through. The id follows from the upload and the line, so a repeated load gives the same ids and no
    task has to count; lines stay below 2^32.
    """
    upload = accepted.select(F.col("path").alias("source_file"), F.col("csv_upload_id").cast("bigint").alias("csv_upload_id"))
    number = F.shiftleft(F.col("csv_upload_id"), LINE_BITS) + F.col(line)
    return rows.join(upload, "source_file").select(
        number.alias("id"), "csv_upload_id", *[c for c in rows.columns if c not in ("source_file", "id", "csv_upload_id")],
        now.alias("created_at"), F.lit(None).cast("timestamp").alias("deleted_at"))
