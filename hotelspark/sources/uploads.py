"""Upload registration: which files are accepted, and the ledger rows they get."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hotelspark.schemas import REPORTS

LIVE = ("COMPLETED", "PROCESSING")


def read_files(spark: SparkSession, paths: str | list[str], file_type: str) -> DataFrame:
    """filename, file_type, content and path of uploaded files, one row each."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("filename"), F.lit(file_type).alias("file_type"), "content", "path"
    )


def is_utf8(content: Column) -> Column:
    """Decoding replaces bad bytes, so a text that encodes back to the same bytes was valid."""
    return F.try_validate_utf8(content.cast("string")).isNotNull()


def register_uploads(files: DataFrame, ledger: DataFrame, *, content: str = "content", now: Column | None = None,
                     types: tuple[str, ...] = tuple(REPORTS)) -> DataFrame:
    """Verdict per file: (filename, file_type, file_hash, status, error_message).

    Accepted files get status PROCESSING; REJECTED ones say why. A hash that is COMPLETED or PROCESSING in the
    ledger is a duplicate, and of several new files with one content exactly one is taken, the first by name,
    then by path if there is one. Only hashes are shuffled, never contents.
    """
    body = F.col(content).cast("binary")
    problem = (
        F.when(~F.col("file_type").isin(*types), F.lit("unsupported file type"))
        .when(~F.lower("filename").endswith(".csv"), F.lit("only CSV files are allowed"))
        .when(body.isNull() | (F.length(body) == 0), F.lit("file is empty"))
        .when(~is_utf8(body), F.lit("file is not UTF-8"))
    )
    path = F.col("path") if "path" in files.columns else F.lit("")
    seen = files.select("filename", "file_type", F.sha2(body, 256).alias("file_hash"), problem.alias("problem"), path.alias("_path"))
    live = ledger.filter(F.col("status").isin(*LIVE)).select("file_hash", F.lit(True).alias("_live")).distinct()
    rank = F.row_number().over(Window.partitionBy("file_hash", F.col("problem").isNull()).orderBy("filename", "_path", "file_type"))
    judged = seen.withColumn("_rank", rank).join(live, "file_hash", "left")
    duplicate = F.coalesce("_live", F.lit(False)) | (F.col("_rank") > 1)
    error = F.coalesce("problem", F.when(duplicate, F.lit("content was uploaded before")))
    return judged.select(
        "filename", "file_type", "file_hash",
        F.when(error.isNull(), F.lit("PROCESSING")).otherwise(F.lit("REJECTED")).alias("status"),
        error.alias("error_message"), *([now.alias("created_at")] if now is not None else []),
    )


def close_uploads(ledger: DataFrame, rows: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Finish PROCESSING uploads: COMPLETED with their row count, FAILED with an error or when no row arrived."""
    done = rows.groupBy(F.col("csv_upload_id").alias("id")).agg(F.count(F.lit(1)).alias("_rows"))
    out = ledger.join(done, "id", "left")
    if failures is not None:
        errors = failures.groupBy("id").agg(F.min("error_message").alias("_error"))
        out = out.join(errors, "id", "left")
    else:
        out = out.withColumn("_error", F.lit(None).cast("string"))
    open_ = F.col("status") == "PROCESSING"
    error = F.coalesce("_error", F.when(F.coalesce("_rows", F.lit(0)) == 0, F.lit("No valid data rows found after parsing and filtering.")))
    return out.withColumns({
        "rows_processed": F.when(open_ & error.isNull(), F.col("_rows").cast("int")).otherwise(F.col("rows_processed")),
        "error_message": F.when(open_, error).otherwise(F.col("error_message")),
        "status": F.when(open_ & error.isNull(), F.lit("COMPLETED")).when(open_, F.lit("FAILED")).otherwise(F.col("status")),
    }).select(*ledger.columns)
