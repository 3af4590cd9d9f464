"""Report exports: CSV files whose header follows a preamble.

A Python data source reads them; each file is one partition, so many exports are parsed in parallel, and a
file is streamed row by row through the standard ``csv`` module into Arrow batches.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

from hotelspark.schemas import REPORTS, ReportKind

FORMAT = "hotel_report_csv"
BATCH_ROWS = 20_000

# Cell texts read as missing.
MISSING = frozenset((
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
))


class ReportError(ValueError):
    """A file without rows or without a required column."""


# Cells may be of any length.
csv.field_size_limit(2**31 - 1)


def _open(path: str) -> io.TextIOWrapper:
    """UTF-8 text of a local path or any URI Arrow can open (hdfs, s3, gs); a byte order mark is skipped."""
    if re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]+://", path) or path.startswith("file:"):
        system, inner = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    else:
        system, inner = fs.LocalFileSystem(), path
    return io.TextIOWrapper(system.open_input_stream(inner), encoding="utf-8-sig", newline="")


def _rows(path: str, skip: int, tolerant: bool) -> Iterator[tuple[int, list[str]]]:
    """(line number, cells): the header first, then data rows; blank lines are passed over."""
    with _open(path) as stream:
        for _ in range(skip):
            stream.readline()
        if tolerant:
            head = stream.readline()
            try:
                delimiter = csv.Sniffer().sniff(head, ",;\t|").delimiter
            except csv.Error:
                delimiter = ","
            lines = (line for part in ((head,), stream) for line in part)
            reader = csv.reader(lines, delimiter=delimiter, quoting=csv.QUOTE_NONE)
        else:
            reader = csv.reader(stream, strict=True)
        for cells in reader:
            if cells:
                yield skip + reader.line_num, cells


def _well_formed(path: str, skip: int) -> bool:
    """Whether strict parsing works: no quoting error and no row longer than the header."""
    try:
        rows = _rows(path, skip, tolerant=False)
        width = len(next(rows)[1])
        return all(len(cells) <= width for _, cells in rows)
    except (csv.Error, StopIteration):
        return False


def read_report(path: str, kind: ReportKind) -> Iterator[dict[str, str | None]]:
    """Mapped rows of one file; tolerant (no quoting, overlong rows skipped) when strict parsing fails."""
    tolerant = not _well_formed(path, kind.skip_rows)
    rows = _rows(path, kind.skip_rows, tolerant)
    try:
        header = [re.sub(r"\s+", " ", h.strip()) for h in next(rows)[1]]
    except StopIteration:
        raise ReportError(f"{path}: CSV file is empty") from None
    if missing := [c for c in kind.required if c not in header]:
        raise ReportError(f"{path}: missing required columns {missing}")
    wanted = {**kind.header_map, **{c: c for c in kind.extra}}
    places = [(header.index(h), name) for h, name in wanted.items() if h in header]
    for line, cells in rows:
        if len(cells) > len(header):
            continue
        clean = [None if c in MISSING else c for c in cells]
        if all(c is None for c in clean):
            continue
        row: dict = {name: clean[i] if i < len(clean) else None for i, name in places}
        row["source_file"], row["line_no"] = path, line
        yield row


class _Partition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ReportReader(DataSourceReader):
    def __init__(self, schema: StructType, kind: ReportKind, paths: Sequence[str], errors: str):
        self.schema, self.kind, self.paths, self.errors = schema, kind, list(paths), errors

    def partitions(self) -> Sequence[InputPartition]:
        return [_Partition(p) for p in self.paths]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in self.schema.fields]
        target = pa.schema([(n, pa.int64() if n == "line_no" else pa.string()) for n in names])

        def batch(rows):
            return pa.RecordBatch.from_pydict({n: [r.get(n) for r in rows] for n in names}, schema=target)

        rows: list[dict] = []
        try:
            for row in read_report(partition.path, self.kind):
                rows.append(row)
                if len(rows) >= BATCH_ROWS:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)
        except (ReportError, UnicodeDecodeError, csv.Error) as problem:
            if self.errors != "row":
                raise
            yield batch([{"source_file": partition.path, "_error": str(problem)}])


class ReportCsvSource(DataSource):
    """``spark.read.format("hotel_report_csv").option("kind", ...).option("paths", json list)``.

    Options: ``kind`` (a report name) or ``skip_rows``/``header_map``/``required``/``extra`` (JSON), and
    ``errors``: ``fail`` (default) or ``row``, which reports an unreadable file as one row with ``_error`` set.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _kind(self) -> ReportKind:
        if "kind" in self.options:
            return REPORTS[self.options["kind"]]
        read = lambda k, d: json.loads(self.options.get(k, d))
        return ReportKind(
            int(self.options.get("skip_rows", "0")), read("header_map", "{}"), tuple(read("required", "[]")),
            tuple(read("extra", "[]")),
        )

    def schema(self) -> StructType:
        kind = self._kind()
        names = [*kind.header_map.values(), *kind.extra, "source_file"]
        fields = [StructField(n, StringType()) for n in names] + [StructField("line_no", LongType())]
        if self.options.get("errors") == "row":
            fields.append(StructField("_error", StringType()))
        return StructType(fields)

    def reader(self, schema: StructType) -> DataSourceReader:
        paths = json.loads(self.options.get("paths", "null")) or [self.options["path"]]
        return ReportReader(schema, self._kind(), paths, self.options.get("errors", "fail"))


def read_report_csv(spark: SparkSession, paths: str | list[str], kind: str | ReportKind, errors: str = "fail") -> DataFrame:
    """Rows of report exports as text columns, with ``source_file`` and ``line_no``."""
    spark.dataSource.register(ReportCsvSource)
    reader = spark.read.format(FORMAT).option("paths", json.dumps([paths] if isinstance(paths, str) else list(paths)))
    if isinstance(kind, str):
        reader = reader.option("kind", kind)
    else:
        reader = (
            reader.option("skip_rows", str(kind.skip_rows)).option("header_map", json.dumps(kind.header_map))
            .option("required", json.dumps(kind.required)).option("extra", json.dumps(kind.extra))
        )
    return reader.option("errors", errors).load()
