"""Helpers shared by the text operators: reliable intermediates, row keys, key runs in Arrow batches, components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separator of words in these operators.
WORD = r"[^\x20\x09-\x0D]+"


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did, if nothing else says where it is."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see; a temporary one only where the session names none (tests on one machine)."""
    reachable(spark)
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="llm-shared-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder: later reads survive lost executors and see the same partitions."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def tasks_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(text: str = "text") -> list[Column]:
    """(k0, k1): the document id and a hash of the text. Rows that agree in both are repeated rows and are treated
    alike; a wrong match would need one id with two texts of one 64-bit hash."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("k0"),
            F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col("doc_id").isNull()).alias("k1")]


def carried(docs: DataFrame, *own: str) -> tuple[Column, list[Column]]:
    """A struct ``carried`` of all columns but ``own``, and the expressions that put the table together again, so that
    helper columns cannot clash with any column of the table."""
    filler = "_" * (1 + max(map(len, docs.columns)))
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in own]
    back = [F.col(c) if c in own else F.col("carried").getField(c).alias(c) for c in docs.columns]
    return F.struct(F.lit(True).alias(filler), *rest).alias("carried"), back


def whole_runs(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int = 20_000) -> Iterator[pa.Table]:
    """Regroup batches sorted by ``keys`` so that no run of equal keys is split over two tables."""
    held: list[pa.RecordBatch] = []
    count, wanted = 0, rows
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < wanted:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        cut = int(run_starts(whole, keys)[-1])
        if cut:
            yield whole.slice(0, cut)
            held, count, wanted = whole.slice(cut).to_batches(), count - cut, rows
        else:
            held, wanted = whole.to_batches(), 2 * count
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def run_starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Index of the first row of every run of equal keys; key columns hold integers without nulls."""
    new = np.zeros(rows.num_rows, dtype=bool)
    new[:1] = True
    for key in keys:
        values = rows.column(key).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def component_min(edges: DataFrame) -> DataFrame:
    """(node, label): every node of the undirected graph ``edges(u, v)`` with the smallest node of its component.

    Alternating large-star and small-star rounds (Kiveris et al. 2014) until nothing changes. A star is an
    aggregation, which combines before its shuffle, and an equi-join whose skewed side Spark may split; the driver
    sees only the number and the hash of the edges. Lineage is cut in the shared folder after each round.
    """
    pairs = settled(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _edge_hash(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Settled, so that the join has two plain shuffles and Spark can split a node with very many neighbours.
        low = settled(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low")))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).filter("u <> v")
        pairs = settled(small.unionByName(low.select("u", F.col("low").alias("v"))).distinct())
        now = _edge_hash(pairs)
        if now == seen:
            break
        seen = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _edge_hash(pairs: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first())
