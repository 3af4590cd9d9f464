"""Substring dedup over fixed-block anchors: the documents' non-overlapping blocks of words are indexed, every rolling
window of a block's size probes the index, and hits are extended to the exact repeats around them.

A window of 13 words holds a whole aligned block of 7 wherever it starts, so a repeat always leaves a hit where one of
its two places has a block. Documents are dealt into chunks and hashes into buckets. A chunk asks about each of its
distinct hashes once, in one packed array per bucket, so a block that stands everywhere costs one entry per chunk, and
the answers are arrays too. The chunks' texts are shuffled once; the three passes over them share that exchange.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotelspark.llm.common import row_key, tasks_for
from hotelspark.llm.suffixes import BUFFER, Hashes, mixed

WORDS = 13
BLOCK = 7
#: Bytes of text in a chunk.
CHUNK = 8 << 20
_BASES = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
_LAST = np.iinfo(np.int64).max

_INKED = np.ones(256, dtype=bool)
_INKED[[9, 10, 11, 12, 13, 32]] = False


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of whole texts and the number of words of each text; words stand between ASCII white space."""
    hashes, counts, start, held = [], [], 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held < BUFFER and i + 1 < len(texts):
            continue
        sizes = np.array([len(t) + 1 for t in texts[start : i + 1]])
        buffer = np.frombuffer(b" ".join(texts[start : i + 1]) + b" ", dtype=np.uint8)
        edges = np.flatnonzero(np.diff(_INKED[buffer], prepend=False))
        hashes.append(Hashes(buffer, _BASES[0]).of(edges[::2], edges[1::2]))
        ends = np.searchsorted(edges[::2], np.cumsum(sizes))
        counts.append(np.diff(ends, prepend=0))
        start, held = i + 1, 0
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    return np.concatenate(hashes), np.concatenate(counts)


class Rolled:
    """The windows of ``size`` words within single texts: hash, text, and word at which each starts."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, size: int):
        kept = np.maximum(counts - size + 1, 0)
        self.text = np.repeat(np.arange(len(counts)), kept)
        self.first = np.cumsum(counts) - counts
        inside = np.arange(kept.sum()) - np.repeat(np.cumsum(kept) - kept, kept)
        self.word = inside + self.first[self.text]
        self.inside = inside
        total = np.zeros(len(hashes), dtype=np.uint64)
        for i in range(size):
            # A rotation and a product per place: the order of words counts.
            turned = hashes[i:] if i == 0 else np.append(hashes[i:], np.zeros(i, dtype=np.uint64))
            total = (total ^ turned) * np.uint64(_BASES[1])
            total ^= total >> np.uint64(32)
        self.hash = mixed(total[self.word])


def _dealt(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes >> np.uint64(33)) % np.uint64(buckets)


def _probes(rolled: Rolled, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct window hashes, whether a block stands on each, and how often each stands."""
    order = np.argsort(rolled.hash)
    found, start, number = np.unique(rolled.hash[order], return_index=True, return_counts=True)
    aligned = (rolled.inside % block == 0)[order]
    return found, np.maximum.reduceat(aligned, start) if len(found) else aligned, number


def _packets(buckets: np.ndarray, chunk: int, *columns: np.ndarray) -> pa.RecordBatch:
    """One row per bucket: the bucket, the chunk, and the bytes of its part of each column."""
    order = np.argsort(buckets, kind="stable")
    which, start = np.unique(buckets[order], return_index=True)
    ends = np.append(start[1:], len(order))[: len(start)]
    packed = [pa.array([c[order[a:b]].tobytes() for a, b in zip(start, ends, strict=True)], pa.binary()) for c in columns]
    return pa.RecordBatch.from_arrays(
        [pa.array(which.astype(np.int32)), pa.array(np.full(len(which), chunk, dtype=np.int32)), *packed],
        names=["bucket", "chunk", "data", "more"][: 2 + len(columns)])


def _unpacked(table: pa.Table, column: str, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of a packed column and the row each came from."""
    parts = [np.frombuffer(x, dtype=kind) for x in table.column(column).to_pylist()]
    if not parts:
        return np.zeros(0, dtype=kind), np.zeros(0, dtype=np.int64)
    return np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def _answers(table: pa.Table, keep: np.ndarray, row: np.ndarray, values: np.ndarray) -> pa.Table:
    """The kept values back to the chunks they came from, packed."""
    chunks, buckets = table.column("chunk").to_pylist(), table.column("bucket").to_pylist()
    order = np.flatnonzero(keep)
    order = order[np.argsort(row[order], kind="stable")]
    rows, start = np.unique(row[order], return_index=True)
    data = [v.tobytes() for v in np.split(values[order], start[1:])] if len(rows) else []
    return pa.table({"chunk": pa.array([chunks[r] for r in rows], pa.int32()), "bucket": pa.array([buckets[r] for r in rows], pa.int32()),
                     "data": pa.array(data, pa.binary())})


def _texts(table: pa.Table) -> tuple[list[bytes], np.ndarray]:
    return [t or b"" for t in table.column("text").to_pylist()], table.column("doc").to_numpy()


def with_repeats(docs: DataFrame, words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) after every word is removed that lies in a window of ``words`` words
    whose sequence also starts in a document with a smaller id.

    Texts are whole; null counts as empty. A missing id stands behind all others. Repeated rows of one id do not
    remove each other, since neither id is smaller.
    """
    if words < 2 * block - 1:
        raise ValueError("a window must hold a whole block wherever it starts")
    spark = docs.sparkSession
    tasks = tasks_for(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(2 * tasks, -(-size // CHUNK))
    spread = F.pmod(F.xxhash64(*row_key()), F.lit(chunks)).cast("int")
    keyed = docs.select(spread.alias("chunk"), "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.col("text").cast("binary").alias("text"))
    by_chunk = keyed.groupBy("chunk")

    def probe(table: pa.Table) -> pa.Table:
        texts, _ = _texts(table)
        found, aligned, _ = _probes(Rolled(*word_hashes(texts), block), block)
        low = (found.astype(np.uint32) & np.uint32(0xFFFFFFFE)) | aligned.astype(np.uint32)
        return pa.Table.from_batches([_packets(_dealt(found, tasks), table.column("chunk")[0].as_py(), low)])

    def match(table: pa.Table) -> pa.Table:
        values, row = _unpacked(table, "data", np.uint32)
        order = np.argsort(values, kind="stable")
        _, start, number = np.unique(values[order] >> np.uint32(1), return_index=True, return_counts=True)
        keep = np.zeros(len(values), dtype=bool)
        if len(start):
            block_there = np.maximum.reduceat(values[order] & np.uint32(1), start) > 0
            keep[order] = np.repeat(block_there & (number > 1), number)
        return _answers(table, keep, row, values >> np.uint32(1))

    def extend(docs_: pa.Table, hits: pa.Table) -> pa.Table:
        """The windows around hits: distinct hashes with the smallest id that has each."""
        texts, ids = _texts(docs_)
        hashes, counts = word_hashes(texts)
        rolled = Rolled(hashes, counts, block)
        found, aligned, number = _probes(rolled, block)
        asked = _dealt(found, tasks).astype(np.uint64) << np.uint64(31) | (found.astype(np.uint32) >> np.uint32(1)).astype(np.uint64)
        values, row = _unpacked(hits, "data", np.uint32)
        answered = np.repeat(hits.column("bucket").to_numpy(), np.bincount(row, minlength=hits.num_rows)).astype(np.uint64) << np.uint64(31) | values.astype(np.uint64)
        hit = found[np.isin(asked, answered) | (number > 1) & aligned]
        marked = np.zeros(len(hashes) + 1, dtype=np.int64)
        marked[rolled.word[np.isin(rolled.hash, hit)]] = 1
        before = np.concatenate(([0], np.cumsum(marked)))
        windows = Rolled(hashes, counts, words)
        near = before[windows.word + words - block + 1] > before[windows.word]
        order = np.lexsort((ids[windows.text[near]], windows.hash[near]))
        found, start = np.unique(windows.hash[near][order], return_index=True)
        least = ids[windows.text[near]][order][start]
        chunk = docs_.column("chunk")[0].as_py() if docs_.num_rows else 0
        return pa.Table.from_batches([_packets(_dealt(found, tasks), chunk, found, least)])

    def compare(table: pa.Table) -> pa.Table:
        """Hashes for which another chunk has a smaller id."""
        values, row = _unpacked(table, "data", np.uint64)
        ids, _ = _unpacked(table, "more", np.int64)
        order = np.lexsort((ids, values))
        _, start, number = np.unique(values[order], return_index=True, return_counts=True)
        keep = np.zeros(len(values), dtype=bool)
        if len(start):
            keep[order] = ids[order] > np.repeat(ids[order][start], number)
        return _answers(table, keep, row, values)

    def remove(docs_: pa.Table, earlier: pa.Table) -> pa.Table:
        texts, ids = _texts(docs_)
        hashes, counts = word_hashes(texts)
        windows = Rolled(hashes, counts, words)
        values, _ = _unpacked(earlier, "data", np.uint64)
        order = np.lexsort((ids[windows.text], windows.hash))
        _, start, number = np.unique(windows.hash[order], return_index=True, return_counts=True)
        gone = np.isin(windows.hash, values)
        if len(start):
            gone[order] |= ids[windows.text][order] > np.repeat(ids[windows.text][order][start], number)
        covered = np.zeros(len(hashes) + words + 1, dtype=np.int64)
        np.add.at(covered, windows.word[gone], 1)
        np.add.at(covered, windows.word[gone] + words, -1)
        covered = np.cumsum(covered)[: len(hashes)] > 0
        ends = np.cumsum(counts)
        removed = np.concatenate(([0], np.cumsum(covered)))
        removed = removed[ends] - removed[ends - counts]
        digests = []
        for text, end, count in zip(texts, ends.tolist(), counts.tolist(), strict=True):
            own = covered[end - count : end]
            kept = text.split()
            if own.any():
                kept = [w for w, x in zip(kept, own.tolist(), strict=True) if not x]
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return pa.table({"doc_id": docs_.column("doc_id"), "n_words": pa.array(counts.astype(np.int64)), "n_removed": pa.array(removed.astype(np.int64)),
                         "kept_sha256": pa.array(digests, pa.string())})

    probes = by_chunk.applyInArrow(probe, "bucket int, chunk int, data binary")
    hits = probes.groupBy("bucket").applyInArrow(match, "chunk int, bucket int, data binary")
    windows = by_chunk.cogroup(hits.groupBy("chunk")).applyInArrow(extend, "bucket int, chunk int, data binary, more binary")
    earlier = windows.groupBy("bucket").applyInArrow(compare, "chunk int, bucket int, data binary")
    return by_chunk.cogroup(earlier.groupBy("chunk")).applyInArrow(remove, "doc_id long, n_words long, n_removed long, kept_sha256 string")
