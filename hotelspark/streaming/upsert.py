"""The latest-version table: append per batch, resolve on read.

Each micro-batch is written to its own ``batch_id=<n>`` folder. Writing a batch again replaces its folder, so
replays after a failure leave one copy. Readers keep the highest version per key, which costs one mergeable
aggregation; no batch ever rewrites what is already stored. ``compact`` folds the table into a new one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hotelspark.operators.mart import latest_by_key

BATCH = "batch_id"


def stamp(df: DataFrame, now: Column | None = None) -> DataFrame:
    """Load time and version (epoch seconds), unless the rows carry their own."""
    now = F.current_timestamp() if now is None else now
    extra = {"ingested_at": now, "version": F.unix_timestamp(now).cast("bigint")}
    return df.withColumns({c: e for c, e in extra.items() if c not in df.columns})


def upsert_latest(batch: DataFrame, path: str, batch_id: int, key: str = "id", version: str = "version") -> None:
    """Store one batch. Rows of a key inside the batch are reduced to the newest first."""
    latest_by_key(stamp(batch), key, version).write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")


def read_latest(spark: SparkSession, path: str, key: str = "id", version: str = "version",
                schema: str | None = None) -> DataFrame:
    """Current rows: per key the highest version, the later batch on ties."""
    reader = spark.read.schema(schema) if schema else spark.read
    rows = reader.option("basePath", path).parquet(path).withColumn(BATCH, F.col(BATCH).cast("bigint"))
    return latest_by_key(rows, key, version, BATCH).drop(BATCH)


def upsert_frames(target: DataFrame, batch: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """The same resolution on two frames: the batch replaces rows of an equal or lower version."""
    both = target.withColumn(BATCH, F.lit(0)).unionByName(stamp(batch).withColumn(BATCH, F.lit(1)))
    return latest_by_key(both, key, version, BATCH).drop(BATCH)


def compact(spark: SparkSession, path: str, new_path: str, key: str = "id", version: str = "version") -> None:
    """Write the resolved table as batch 0 of a new location; point readers and writers there afterwards.

    Later batches keep their numbers, so a stream that goes on from its checkpoint starts above zero.
    """
    read_latest(spark, path, key, version).write.mode("error").parquet(f"{new_path}/{BATCH}=0")


def stream_into_table(df: DataFrame, path: str, checkpoint: str, key: str = "id", version: str = "version",
                      prepare: Callable[[DataFrame], DataFrame] | None = None, available_now: bool = False) -> StreamingQuery:
    """Keep a latest-version table from a stream. Batch numbers start at 1; 0 is left to ``compact``."""
    def store(batch: DataFrame, batch_id: int) -> None:
        upsert_latest(prepare(batch) if prepare else batch, path, batch_id + 1, key, version)

    writer = df.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
