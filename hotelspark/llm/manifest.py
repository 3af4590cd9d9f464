"""Merkle dataset manifest by incremental witnesses.

Every document row is a leaf. Within a group (a language) leaves stand in ascending order and are appended to a
binary Merkle tree: every two consecutive nodes of a level become the hash of both, a lone last node the hash of
itself, until one node, the group's subroot, remains. The subroots, ordered by group, are appended to the same kind
of tree, whose last node is the root.

The appends run in aligned blocks of ``BLOCK`` nodes. A block is a stream of appends: each node starts a partial
witness, and every later sibling that completes a subtree above it extends the witness by that sibling. The block's
root is then one more append at the level above, so block roots of the whole corpus are folded the same way, block
by block, until each group (and then the corpus) has one node. A leaf's proof is its own witness followed by the
witnesses of the block roots above it; these are joined top down, a block at a time, so no group and no level is
ever held in one task: a block holds at most ``BLOCK`` rows, and hot languages only make more blocks.

Fixed format of a leaf (part of the contract, not a choice): a field is ``-`` when null, else its UTF-8 byte count,
``:`` and its value, integers written in decimal; fields in the order doc_id, source, lang, n_chars, text. A hash is
the lowercase hex SHA-256 of its inputs concatenated, digests taken as their hex text.

Cases: null fields are written ``-``; a null lang is a group of its own and comes first; leaves of equal doc_id are
ordered by their leaf hash, so repeated rows are equal leaves next to each other and each gets its own place; an
empty table gives no rows; a lone leaf of a group is its subroot, and a lone subroot is the root; columns other than
the five named ones are neither read nor returned.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hotelspark.llm.common import settled

#: Nodes of one level in one block; a power of two, so blocks of every level stay aligned with the pairs.
BLOCK = 256

_WITNESS = T.StructType([
    T.StructField("root", T.StringType()),
    T.StructField("siblings", T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("lefts", T.ArrayType(T.ArrayType(T.BooleanType()))),
])


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count of the text, ``:`` and the text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(field(doc_id), field(source), field(lang), field(n_chars), field(text)), 256)


def tampered(n_chars: Column) -> Column:
    """n_chars plus one where 7 divides the unsigned CRC-32 of the decimal doc_id; nulls stay as they are."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return F.when(hit & n_chars.isNotNull(), n_chars + 1).otherwise(n_chars)


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def append_block(hashes: list[str], levels: int) -> tuple[str, list[list[str]], list[list[bool]]]:
    """Stream ``hashes`` into a tree of ``levels`` levels by appends. Returns the block's root and, per node, its
    witness: the sibling of each level from the bottom ('' where the node stood alone) and whether it was the left
    one. A witness is opened when its node is appended and extended when a later sibling completes a subtree."""
    n = len(hashes)
    siblings: list[list[str]] = [[] for _ in range(n)]
    lefts: list[list[bool]] = [[] for _ in range(n)]
    # Open subtrees: (level, hash, first member, last member + 1); a pair of equal levels completes the upper one.
    open_: list[tuple[int, str, int, int]] = []

    def close(upto: int) -> None:
        while len(open_) >= 2 and open_[-1][0] == open_[-2][0] and open_[-1][0] < upto:
            level, right, mid, end = open_.pop()
            _, left, start, _ = open_.pop()
            for i in range(start, mid):
                siblings[i].append(right)
                lefts[i].append(True)
            for i in range(mid, end):
                siblings[i].append(left)
                lefts[i].append(False)
            open_.append((level + 1, _h(left + right), start, end))

    for i, h in enumerate(hashes):
        open_.append((0, h, i, i + 1))
        close(levels)
    # The last, unpaired subtrees climb alone (their own hash) until they meet the one before them.
    while len(open_) > 1 or (open_ and open_[0][0] < levels):
        level, top, start, end = open_.pop()
        for i in range(start, end):
            siblings[i].append("")
            lefts[i].append(True)
        open_.append((level + 1, _h(top), start, end))
        close(levels)
    return (open_[0][1] if open_ else ""), siblings, lefts


def levels_of(count: int, whole: bool, depth: int) -> int:
    """Levels a block folds: all ``depth`` if more blocks follow in its group, else until one node is left."""
    return depth if not whole else max(count - 1, 0).bit_length()


@F.pandas_udf(_WITNESS)
def _fold(hashes: pd.Series, whole: pd.Series, depth: pd.Series) -> pd.DataFrame:
    out = [append_block(list(h), levels_of(len(h), w, d)) for h, w, d in zip(hashes, whole, depth, strict=True)]
    return pd.DataFrame({"root": [o[0] for o in out], "siblings": [o[1] for o in out], "lefts": [o[2] for o in out]})


def positions(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with ``pos``: the place (from 0) of each row within its ``group`` by ``order``.

    A range sort spreads even one hot group over many tasks; each task's rows are counted per group, the counts are
    summed into offsets (one row per task and group) and joined back by (task, group), which is never skewed.
    """
    sorted_ = rows.orderBy(group, *order).withColumns(
        {"_task": F.spark_partition_id(), "_local": F.monotonically_increasing_id()})
    sorted_ = settled(sorted_.withColumn("_local", F.col("_local") - F.shiftleft(F.col("_task").cast("long"), 33)))
    counts = sorted_.groupBy("_task", group).agg(F.count(F.lit(1)).alias("_n"), F.min("_local").alias("_first"))
    tasks = counts.groupBy("_task").agg(F.sum("_n").alias("_n"))
    before = tasks.select("_task", (F.sum("_n").over(Window.orderBy("_task")) - F.col("_n")).alias("_offset"))
    starts = counts.join(before, "_task").withColumn("_at", F.col("_offset") + F.col("_first"))
    starts = starts.withColumn("_start", F.min("_at").over(Window.partitionBy(group)))
    return sorted_.join(starts.select("_task", group, "_offset", "_start"), ["_task", group]).withColumn(
        "pos", F.col("_offset") + F.col("_local") - F.col("_start")).drop("_task", "_local", "_offset", "_start")


def fold(nodes: DataFrame, group: str, block: int = BLOCK) -> tuple[list[DataFrame], DataFrame]:
    """Fold ``nodes(group, pos, hash)`` block by block until each group has one node.

    Returns the witness table of every round (group, pos, siblings, lefts: arrays of that round's levels) and the
    last round's nodes (group, hash): one per group.
    """
    rounds = []
    while True:
        blocks = nodes.groupBy(group, (F.col("pos") / block).cast("long").alias("block")).agg(
            F.sort_array(F.collect_list(F.struct("pos", "hash"))).alias("members"))
        whole = (F.col("block") == 0) & (F.size("members") < block)
        folded = settled(blocks.select(group, "block", F.col("members.pos").alias("at"),
                                       _fold(F.col("members.hash"), whole, F.lit(block.bit_length() - 1)).alias("w")))
        rounds.append(folded.select(group, F.posexplode(F.arrays_zip("at", "w.siblings", "w.lefts")).alias("i", "m")).select(
            group, F.col("m.at").alias("pos"), F.col("m.siblings").alias("siblings"), F.col("m.lefts").alias("lefts")))
        nodes = folded.select(group, F.col("block").alias("pos"), F.col("w.root").alias("hash"))
        if nodes.filter("pos > 0").isEmpty():
            return rounds, nodes.drop("pos")


def unfold(rounds: list[DataFrame], group: str, top: DataFrame, block: int = BLOCK) -> DataFrame:
    """Witnesses of the last round's members joined down to the first round: (group, pos, siblings, lefts, ...) of
    every first-round node, with the arrays of ``top(group, siblings, lefts, ...)`` (the levels above the group) at the
    end and its other columns carried along. Each join meets one parent row with at most ``BLOCK`` members."""
    above = top
    extra = [c for c in top.columns if c not in (group, "siblings", "lefts")]
    for i in range(len(rounds) - 1, -1, -1):
        members = rounds[i].select(group, "pos", F.col("siblings").alias("_s"), F.col("lefts").alias("_l"),
                                   (F.col("pos") / block).cast("long").alias("_parent"))
        parent = above.withColumnsRenamed({"siblings": "_ps", "lefts": "_pl"})
        keys = [group] if i == len(rounds) - 1 else [group, "_parent"]
        if i < len(rounds) - 1:
            parent = parent.withColumnRenamed("pos", "_parent")
        above = members.join(parent, keys).select(
            group, "pos", F.concat("_s", "_ps").alias("siblings"), F.concat("_l", "_pl").alias("lefts"), *extra)
        if i:
            above = settled(above)
    return above


def refold(start: Column, siblings: Column, lefts: Column) -> Column:
    """The root reached from ``start`` through ``siblings``: a node with a left sibling '' stood alone."""
    steps = F.arrays_zip(siblings.alias("s"), lefts.alias("l"))
    return F.aggregate(steps, start, lambda acc, x: F.when(x["s"] == "", F.sha2(acc, 256)).when(
        x["l"], F.sha2(F.concat(acc, x["s"]), 256)).otherwise(F.sha2(F.concat(x["s"], acc), 256)))


def manifest(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root (from the tampered leaf), verified.

    ``block`` (a power of two) only changes how the work is cut, never a hash."""
    cols = [F.col(f"`{c}`") for c in ("doc_id", "source", "lang", "n_chars", "text")]
    rows = docs.select(*cols).select(
        "doc_id", F.coalesce(F.concat(F.lit("1"), F.col("lang")), F.lit("0")).alias("g"),
        leaf(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]).alias("leaf"),
        leaf(*[F.col("doc_id"), F.col("source"), F.col("lang"), tampered(F.col("n_chars")), F.col("text")]).alias("forged"))
    placed = positions(rows, "g", "doc_id", "leaf")
    rounds, subroots = fold(placed.select("g", "pos", F.col("leaf").alias("hash")), "g", block)
    ranked = positions(subroots.select(F.lit(0).alias("all"), "g", "hash"), "all", "g")
    top_rounds, root = fold(ranked.select("all", "pos", "hash"), "all", block)
    nothing = {"siblings": F.array().cast("array<string>"), "lefts": F.array().cast("array<boolean>")}
    above = unfold(top_rounds, "all", root.select("all", F.col("hash").alias("root")).withColumns(nothing), block)
    top = ranked.select("all", "pos", "g", F.col("hash").alias("subroot")).join(above, ["all", "pos"])
    witness = unfold(rounds, "g", top.select("g", "siblings", "lefts", "subroot", "root"), block)
    out = placed.join(witness, ["g", "pos"])
    siblings, lefts = F.col("siblings"), F.col("lefts")
    folded = refold(F.col("forged"), siblings, lefts)
    return out.select(
        "doc_id", "leaf", "subroot", "root",
        F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"), folded.alias("folded_root"),
        (folded == F.col("root")).alias("verified"))
