"""Session helpers: defaults for local work and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

HOTEL_ZONE = "Asia/Jakarta"

# Generated methods above this many bytes of bytecode are never compiled by the JVM; beyond it Spark had better
# use its per-expression projections, which are split into small methods. Wide cleaning jobs gain most.
HUGE_METHOD_LIMIT = "8000"


def build_session(app: str = "hotelspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE on and the hotel's time zone; ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", HOTEL_ZONE)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.codegen.hugeMethodLimit", HUGE_METHOD_LIMIT)
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared ``spark.checkpoint.dir``.

    A temporary folder is chosen only for local masters that name none; on a cluster a missing
    setting is an error, because executors could not reach a machine-local folder.
    """
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if shared:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(shared)
        return
    if sc.getCheckpointDir() is not None:
        return
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="hotelspark-checkpoint-"))
