"""Report exports read in byte ranges: a splittable, quote-aware CSV parse.

Spark's text reader cuts every file into ranges (``spark.sql.files.maxPartitionBytes``), so one large export is read
by many tasks. A line ends a record when the number of quotes before its end is even (RFC 4180: quotes only stand
in quoted cells, doubled inside them). Each range counts the parity of its quotes; a prefix scan over the ranges of a
file (one row per range) settles the parity at every range's start, and a running sum inside each range settles it
at every line. A record is then the run of lines up to the next even line; it is cut into cells by a regular
expression, quoted cells unquoted, all in Spark SQL. Lines and ranges get their numbers the same way: counts per
range, summed over the ranges before.

Files are judged as the one-file reader judges them: a file whose quotes do not pair up, whose records are not
well-formed (a closing quote followed by other text) or that holds a record longer than its header is read without
quoting, each physical line a row, split by the delimiter that the header line suggests (``,``, ``;``, tab or ``|``),
rows longer than the header skipped. The first ``skip_rows`` physical lines are passed over, a byte order mark at a
file's start is dropped, blank records are skipped, cells in ``MISSING`` are null and rows of nulls only are
skipped. ``line_no`` is the physical line (from 1) where a record ends; ``source_file`` is the file's URI.

Differs from the one-file reader where a quote stands inside an unquoted cell (``a"b``): Python's reader keeps it as
text, the ranged parse counts it as a quote, so the file is read without quoting when its quotes do not pair up.
"""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hotelspark.schemas import REPORTS, ReportKind
from hotelspark.session import ensure_checkpoint_dir
from hotelspark.sources.report_csv import MISSING, ReportError

#: Ranges of a read above this count are joined back by a shuffle, below it by a broadcast of the range table.
BROADCAST_RANGES = 200_000

_CELL = r'"(?:[^"]++|"")*+"|(?:[^,"][^,]*+)?'
_RECORD = rf"^(?:{_CELL})(?:,(?:{_CELL}))*+$"


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_RANGES else df


def _quotes(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))


def ranged_lines(spark: SparkSession, paths: list[str], skip: int) -> DataFrame:
    """(file, range, idx, line, start, end, rec): every physical line with its number in the file (from 0), whether a
    record starts or ends with it, and the number of the line that ends its record (preamble lines are records)."""
    raw = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"),
        F.monotonically_increasing_id().alias("mid"), F.col("value").alias("line"))
    ranges = raw.groupBy("file", "range").agg(F.count(F.lit(1)).alias("n"), F.min("mid").alias("first"))
    by_file = Window.partitionBy("file").orderBy("range")
    ranges = ranges.withColumn("offset", F.sum("n").over(by_file) - F.col("n"))
    count = ranges.count()
    lines = raw.join(_small(ranges, count), ["file", "range"]).select(
        "file", "range", (F.col("offset") + F.col("mid") - F.col("first")).alias("idx"),
        F.when(F.col("offset") + F.col("mid") - F.col("first") == 0, F.regexp_replace("line", "^﻿", "")).otherwise(
            F.col("line")).alias("line"))
    lines = lines.withColumn("q", F.when(F.col("idx") < skip, 0).otherwise(_quotes(F.col("line")) % 2))
    parity = lines.groupBy("file", "range").agg((F.sum("q") % 2).alias("p"))
    parity = parity.withColumn("p0", (F.sum("p").over(by_file) - F.col("p")) % 2)
    inside = Window.partitionBy("file", "range").orderBy("idx")
    lines = lines.join(_small(parity.select("file", "range", "p0"), count), ["file", "range"]).withColumn(
        "_before", F.col("p0") + F.sum("q").over(inside) - F.col("q")).withColumns({
            "start": (F.col("idx") < skip) | (F.col("_before") % 2 == 0),
            "end": (F.col("idx") < skip) | ((F.col("_before") + F.col("q")) % 2 == 0)})
    # A running minimum from the range's end backwards: each row adds one step, where a frame reaching forward
    # would be summed again for every row.
    backwards = Window.partitionBy("file", "range").orderBy(F.col("idx").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("next_end", F.min(F.when(F.col("end"), F.col("idx"))).over(backwards))
    firsts = lines.groupBy("file", "range").agg(F.min(F.when(F.col("end"), F.col("idx"))).alias("f"))
    later = Window.partitionBy("file").orderBy("range").rowsBetween(1, Window.unboundedFollowing)
    firsts = firsts.withColumn("after", F.min("f").over(later))
    return lines.join(_small(firsts.select("file", "range", "after"), count), ["file", "range"]).select(
        "file", "range", "idx", "line", "start", "end", F.coalesce("next_end", "after").alias("rec"), "q")


def records(lines: DataFrame) -> DataFrame:
    """(file, rec, record): lines of each record joined by newlines, a closing carriage return dropped. A record
    that never ends (quotes that do not pair up) keeps ``rec`` null."""
    alone = F.col("start") & F.col("end")
    single = lines.filter(alone).select("file", "rec", F.col("line").alias("record"))
    several = lines.filter(~alone).groupBy("file", "rec").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("idx", "line"))).line, "\n").alias("record"))
    return single.unionByName(several).withColumn("record", F.regexp_replace("record", "\r$", ""))


def _cells(record: Column) -> Column:
    """Cells of a well-formed record, quoted cells without their quotes and with doubled quotes single."""
    found = F.regexp_extract_all(record, F.lit(rf"(?:^|,)({_CELL})"), 1)
    return F.transform(found, lambda c: F.when(c.startswith('"'), F.regexp_replace(
        F.regexp_replace(c, '^"|"$', ""), '""', '"')).otherwise(c))


def _sniff(header: str) -> str:
    try:
        return csv.Sniffer().sniff(header, ",;\t|").delimiter
    except csv.Error:
        return ","


def read_report_csv_ranged(spark: SparkSession, paths: str | list[str], kind: str | ReportKind) -> DataFrame:
    """Rows of report exports as text columns, with ``source_file`` and ``line_no``; many tasks per large file.

    The driver holds one row per file (its header, how it is read): no more than the list of paths it was given."""
    kind = REPORTS[kind] if isinstance(kind, str) else kind
    paths = [paths] if isinstance(paths, str) else list(paths)
    skip = kind.skip_rows
    # Lines are read, numbered and shuffled once into the checkpoint folder; the three passes below (how each file's
    # records look, its first line, the rows) read them back instead of reading and shuffling the files again.
    ensure_checkpoint_dir(spark)
    lines = ranged_lines(spark, paths, skip).checkpoint()
    recs = records(lines.filter(F.col("idx") >= skip)).filter("record <> ''")
    parsed = recs.withColumn("cells", _cells(F.col("record"))).withColumn(
        "ok", F.col("record").rlike(_RECORD) & F.col("rec").isNotNull())
    # Two passes of one row per file: how its records look, and its first non-blank physical line.
    judged = parsed.groupBy("file").agg(
        F.min(F.col("ok").cast("int")).alias("ok"), F.max(F.size("cells")).alias("width"),
        F.min(F.when(F.col("rec").isNotNull(), F.struct("rec", "record"))).alias("head"))
    files = {r.file: r for r in judged.collect()}
    firsts = lines.filter(F.col("idx") >= skip).groupBy("file").agg(F.min(F.when(
        F.regexp_replace("line", "\r$", "") != "", F.struct("idx", "line"))).alias("head"))
    plain_heads = {r.file: r.head and (r.head.idx, r.head.line.rstrip("\r")) for r in firsts.collect()}
    heads = {f: (r.head.rec, r.head.record) for f, r in files.items() if r.head is not None}
    listed = set(plain_heads)
    if empty := sorted(f for f, h in plain_heads.items() if h is None):
        raise ReportError(f"{empty}: CSV file is empty")
    wanted = {**kind.header_map, **{c: c for c in kind.extra}}
    names = list(dict.fromkeys(wanted.values()))
    plan = []
    for file in sorted(listed):
        strict = file in heads and files[file].ok == 1
        if strict:
            cells = next(csv.reader([heads[file][1]]), [])
            strict = files[file].width <= len(cells)
        if strict:
            at, delimiter = heads[file][0], ","
        else:
            at, text = plain_heads[file]
            delimiter = _sniff(text)
            cells = text.split(delimiter)
        header = [" ".join(h.split()) for h in cells]
        if missing := [c for c in kind.required if c not in header]:
            raise ReportError(f"{file}: missing required columns {missing}")
        where = [header.index(h) if h in header else -1 for h in wanted]
        plan.append((file, strict, at, re.escape(delimiter), len(header), where))
    schema = "file string, strict boolean, at long, delimiter string, width int, places array<int>"
    plans = spark.createDataFrame(plan, schema)
    quoted = parsed.select("file", F.col("rec").alias("idx"), "cells")
    both = quoted.withColumn("strict", F.lit(True)).unionByName(
        lines.filter(F.col("idx") >= skip).select("file", "idx", F.regexp_replace("line", "\r$", "").alias("_text")).withColumn(
            "strict", F.lit(False)), allowMissingColumns=True)
    rows = both.join(_small(plans, len(plan)), ["file", "strict"]).filter(F.col("idx") > F.col("at"))
    rows = rows.withColumn("cells", F.when(F.col("strict"), F.col("cells")).otherwise(
        F.split(F.col("_text"), F.col("delimiter"), -1)))
    rows = rows.filter(F.col("strict") | (F.col("_text") != "")).filter(F.size("cells") <= F.col("width"))
    clean = F.transform("cells", lambda c: F.when(c.isin(*MISSING), F.lit(None)).otherwise(c))
    rows = rows.withColumn("cells", clean).filter(F.exists("cells", lambda c: c.isNotNull()))
    picks = {name: F.lit(None).cast("string") for name in names}
    for i, name in enumerate(wanted.values()):
        place = F.col("places")[i]
        picks[name] = F.coalesce(F.when(place >= 0, F.get(F.col("cells"), place)), picks[name])
    return rows.select(*[picks[n].alias(n) for n in names], F.col("file").alias("source_file"),
                       (F.col("idx") + 1).alias("line_no"))


def _cell(value: Column) -> Column:
    """A CSV cell: quoted (quotes doubled) when it holds a delimiter, quote or line break; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def write_export(rows: DataFrame, folder: str, headers: list[str], preamble: list[str], file_bytes: int = 256 << 20) -> str:
    """Write ``rows`` (one column per header) as report exports under ``folder``: files of about ``file_bytes``,
    each with the preamble, the header and a share of the rows. Returns ``folder``."""
    line = F.concat_ws(",", *[_cell(F.col(f"`{c}`")) for c in rows.columns])
    size = rows.select(F.sum(F.octet_length(line) + 1).alias("b")).first().b or 0
    files = max(1, -(-size // file_bytes))
    body = rows.select(F.pmod(F.xxhash64(line), F.lit(files)).alias("b"), F.lit(0).alias("o"), line.alias("value"))
    top = [*preamble, ",".join(headers)]
    spark = rows.sparkSession
    lines = F.array(*[F.struct(F.lit(i - len(top)).alias("o"), F.lit(t).alias("value")) for i, t in enumerate(top)])
    head = spark.range(files).select(F.col("id").alias("b"), F.explode(lines).alias("h")).select("b", "h.o", "h.value")
    body.unionByName(head).repartition("b").sortWithinPartitions("b", "o").drop("o").write.partitionBy("b").text(folder)
    return folder
