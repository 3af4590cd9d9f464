"""Change-event streams and the four cleaning jobs that run on them."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from hotelspark.operators.clean import CLEANERS
from hotelspark.schemas import EVENTS

KEPT_OPERATIONS = ("c", "u")


def decode_changes(values: DataFrame, payload: T.StructType | str, value: str = "value") -> DataFrame:
    """JSON envelopes {after, op} -> payload columns of creates and updates; snapshots and deletes are dropped."""
    fields = payload if isinstance(payload, T.StructType) else T.StructType.fromDDL(payload)
    envelope = T.StructType([T.StructField("after", fields), T.StructField("op", T.StringType())])
    data = F.from_json(F.col(value).cast("string"), envelope)
    return values.select(data.alias("d")).filter(F.col("d.op").isin(*KEPT_OPERATIONS)).select("d.after.*")


def read_cdc(spark: SparkSession, format: str, options: Mapping[str, str], payload: T.StructType | str, stream: bool = True) -> DataFrame:
    """Change events as payload rows.

    ``kafka`` starts at the earliest offsets; ``maxOffsetsPerTrigger`` in the options limits a batch, which nothing
    does by default. ``text`` reads files with one JSON value per line (``path`` required).
    """
    options = dict(options)
    reader = spark.readStream if stream else spark.read
    if format == "kafka":
        options = {"startingOffsets": "earliest", **options}
        if not stream:
            options.pop("maxOffsetsPerTrigger", None)
    elif format == "text":
        reader = reader.schema("value string")
    return decode_changes(reader.format(format).options(**options).load(), payload)


def as_json_values(df: DataFrame) -> DataFrame:
    """One JSON text per row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_json_stream(df: DataFrame, format: str, options: Mapping[str, str], checkpoint: str,
                      available_now: bool = False, name: str | None = None) -> StreamingQuery:
    """Append every row as one JSON value to Kafka (``topic``) or text files (``path``), checkpointed."""
    writer = as_json_values(df).writeStream.format(format).options(**dict(options)).option("checkpointLocation", checkpoint)
    writer = writer.outputMode("append")
    if name:
        writer = writer.queryName(name)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


@dataclass(frozen=True)
class Job:
    """Where one cleaning job reads and writes."""

    source_format: str
    source: Mapping[str, str]
    sink_format: str
    sink: Mapping[str, str]
    checkpoint: str
    cleaner: Callable[[DataFrame], DataFrame] | None = field(default=None)


def chosen_jobs(names: str = "all") -> list[str]:
    """Comma list of job names, spaces allowed; 'all' or blank means every job, an unknown name is an error."""
    wanted = [n.strip() for n in names.lower().split(",") if n.strip()] or ["all"]
    if wanted == ["all"]:
        return list(CLEANERS)
    if unknown := [n for n in wanted if n not in CLEANERS]:
        raise ValueError(f"unknown jobs: {', '.join(unknown)}")
    return wanted


def start_job(spark: SparkSession, name: str, job: Job, available_now: bool = False) -> StreamingQuery:
    events = read_cdc(spark, job.source_format, job.source, EVENTS[name])
    clean = (job.cleaner or CLEANERS[name])(events)
    return write_json_stream(clean, job.sink_format, job.sink, job.checkpoint, available_now, name)


def run_jobs(spark: SparkSession, jobs: Mapping[str, Job], names: str = "all", available_now: bool = False) -> list[StreamingQuery]:
    """Start the named jobs and wait for all of them; the first failure is raised as soon as it happens."""
    wanted = chosen_jobs(names)
    if names.strip().lower() in ("", "all"):
        wanted = [n for n in wanted if n in jobs]
    elif missing := [n for n in wanted if n not in jobs]:
        raise ValueError(f"no settings for jobs: {', '.join(missing)}")
    queries = [start_job(spark, n, jobs[n], available_now) for n in wanted]
    running = list(queries)
    while running:
        for q in list(running):
            # Raises when the query has failed.
            if q.awaitTermination(1):
                running.remove(q)
    return queries
