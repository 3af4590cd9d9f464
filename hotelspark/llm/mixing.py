"""Mixing sources to target weights: hash-random order within each source, distributed prefix sums of sizes, and a
cut at each source's exact budget; a budget beyond one epoch starts over."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotelspark.llm.common import WORD, carried, row_key, settled, tasks_for

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
#: The table of targets is broadcast up to this many sources; beyond it the join shuffles, and Spark splits hot sources.
BROADCAST_SOURCES = 10_000


def word_count(text: str = "text") -> Column:
    """Number of words between ASCII white space, as a long; null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def prefix_sums(rows: DataFrame, order: list[str], values: dict[str, str]) -> DataFrame:
    """``rows`` range-sorted by ``order`` with the sum of earlier rows of each column in ``values`` under its new name.

    Rows are range-partitioned and sorted once and settled; the driver adds up one number per partition and column.
    """
    spark = rows.sparkSession
    ranged = settled(rows.repartitionByRange(tasks_for(spark), *order).sortWithinPartitions(*order))
    sums = ranged.groupBy(F.spark_partition_id().alias("part")).agg(*[F.sum(c).alias(c) for c in values]).orderBy("part").collect()
    starts, so_far = {}, dict.fromkeys(values, 0)
    for row in sums:
        starts[row["part"]] = dict(so_far)
        so_far = {c: so_far[c] + (row[c] or 0) for c in values}

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = dict(starts.get(TaskContext.get().partitionId(), {}))
        for batch in batches:
            if not batch.num_rows:
                continue
            for column, name in values.items():
                sizes = batch.column(column)
                ends = pc.add(pc.cumulative_sum(sizes), at[column])
                batch = batch.append_column(name, pc.cast(pc.subtract(ends, sizes), pa.int64()))
                at[column] = ends[-1].as_py()
            yield batch

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema) + "".join(f", `{n}` long" for n in values.values())
    return ranged.mapInArrow(running, schema)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, first, target) from (source, source_size), one row per source.

    Sources stand in code-point order, null last, and take the weights in turn. ``share`` of all sizes is dealt by
    weight; a target stops at ``most`` times its source's size and the excess goes to the others. Sources are full
    exactly when the level at which they fill up leaves the total unreached, which prefix sums over the filling
    levels tell without a loop. ``first`` is the size of all earlier sources.
    """
    ranked = prefix_sums(sizes.withColumns({"last": F.col("source").isNull(), "one": F.lit(1).cast("long")}),
                         ["last", "source"], {"source_size": "first", "one": "rank"})
    weighed = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    levels = prefix_sums(weighed.withColumn("level", F.lit(most) * F.col("source_size") / F.col("weight")),
                         ["level", "rank"], {"source_size": "size_before", "weight": "weight_before"})
    levels = settled(levels)
    totals = levels.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    size, weight = totals.first() or (0, 0)
    wanted = share * float(size or 0)
    full = (F.lit(most) * (F.col("size_before") + F.col("source_size")) + F.col("level") * (F.lit(weight or 0) - F.col("weight_before") - F.col("weight"))) <= wanted
    levels = levels.withColumn("full", full)
    taken, used = levels.filter("full").agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level = (wanted - most * taken) / ((weight or 0) - used) if weight and weight > used else 0.0
    target = F.when(F.col("full"), F.lit(most) * F.col("source_size")).otherwise(
        F.least(F.lit(level) * F.col("weight"), F.lit(most) * F.col("source_size")))
    return levels.select("source", "source_size", "first", target.alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 0) -> DataFrame:
    """(doc_id, k0, k1, size, source, source_size, target, taken): how many words the mix takes of each document.

    The order within a source is that of ``md5(seed|doc_id)``, then of the id, size and text hash, so reruns agree
    and a hot source is cut into as many ranges as it needs. Whole epochs come first; the rest of the budget, rounded
    to a whole word, is cut within one document. Null text has size 0; rows without an id stand together. Repeated
    rows count as documents of their own. Extra columns are left out; join on (k0, k1) to get them.
    """
    rows = docs.select(
        "doc_id", *row_key(), "source", F.col("source").isNull().alias("last"), word_count().alias("size"),
        F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string")).cast("binary")).alias("key"))
    ordered = settled(prefix_sums(rows, ["last", "source", "key", "doc_id", "size", "k1"], {"size": "before"}))
    sizes = ordered.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, most).withColumn("budget", F.floor(F.col("target") + 0.5))
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0))
    rest = F.col("budget") - epochs * F.col("source_size") - (F.col("before") - F.col("first"))
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    targets = settled(targets)
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    joined = ordered.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    return joined.select("doc_id", "k0", "k1", "size", F.col("d.source").alias("source"), "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, mix: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it was taken whole, and the cut ones shortened to their first words.

    Documents without words are not taken. Repeated rows take the same number of words each.
    """
    rest, back = carried(docs, "text")
    plan = mix.filter("taken > 0").groupBy("k0", "k1").agg(F.max("size").alias("size"), F.max("taken").alias("taken"))
    rows = docs.select(rest, "text", *row_key()).join(plan, ["k0", "k1"])
    rows = rows.withColumn("take", F.explode(F.expr(
        "transform(sequence(1, cast(ceil(taken / size) as int)), i -> if(i * size <= taken, size, taken % size))")))
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD), 0), 1, F.col("take").cast("int"))
    text = F.when(F.col("take") == F.col("size"), F.col("text")).otherwise(F.array_join(words, " "))
    return rows.withColumn("text", text).select(*back)
