"""SimHash near-dedup over a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 3 bits agree in at least 5 of their 8 bytes. A posting list holds the
fingerprints with given bytes in given places; 5 agreeing bytes always put 3 into one half of the fingerprint, so
lists are kept for the 8 triples of places within a half, and no list is as long as one of a single byte. Within a
list the agreeing positional bytes of each pair are tallied, pairs that reach 5 stay, and their bits are compared.
A list that is too long for that is dealt out again by two more places; there all pairs have their differences in
the last three bytes, and each fingerprint looks up its neighbours instead of being compared with all others.
Only links that join parts of a list leave it, at most one fewer than its members, so no pair list grows with the
square of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hotelspark.llm.common import carried, component_min, row_key, run_starts, settled, tasks_for, whole_runs

SHINGLE = 3
MAX_BITS = 3
SEED = 42
#: Longest posting list whose pairs are tallied; longer ones are dealt out by two more places.
LONGEST = 2048

_TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
_BIT_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_BITS = np.array([bin(x).count("1") for x in range(1 << 16)], dtype=np.uint8)


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a whole text: ASCII letters lower-cased, words between ASCII white space, shingles with repeats.
    Fewer words than a shingle make one; null and wordless texts give 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else iter([b" ".join(words)])
    count = max(len(words) - shingle + 1, 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), dtype=np.uint64, count=count)
    ones = np.zeros((8, 8), dtype=np.int64)
    for at in range(0, count, 1 << 16):
        octets = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        for place in range(8):
            ones[place] += np.bincount(octets[:, place], minlength=256) @ _BIT_OF_BYTE
    return sum(1 << int(bit) for bit in np.flatnonzero(2 * ones.reshape(-1) > count))


def with_fingerprint(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """All columns of ``docs`` and ``fp``, the fingerprint as a signed long."""
    schema = T.StructType([*docs.schema.fields, T.StructField("fp", T.LongType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(None if (x := v.as_py()) is None else x.encode(), shingle) for v in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(found, dtype=np.uint64).view(np.int64))], names=[*batch.schema.names, "fp"])

    return docs.mapInArrow(add, schema)


def _places(fps: np.ndarray) -> np.ndarray:
    return fps.view(np.uint8).reshape(-1, 8)


def _key(fps: np.ndarray, places: tuple[int, ...]) -> np.ndarray:
    """Which places are fixed, and the bytes that stand there, in one long."""
    octets, key = _places(fps), np.full(len(fps), sum(1 << p for p in places), dtype=np.int64)
    for p in places:
        key = key << 8 | octets[:, p]
    return key


def _bits(x: np.ndarray) -> np.ndarray:
    return _BITS[x.view(np.uint16).reshape(*x.shape, 4)].sum(axis=-1, dtype=np.uint8)


class _Parts:
    """Joins members of one list; answers whether a link joined two parts."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def join(self, a: int, b: int) -> bool:
        up = self.up
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        up[max(a, b)] = min(a, b)
        return a != b


def _tallied(fps: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Links of a short list: count shared positional bytes of each pair, keep those with enough, compare bits."""
    parts, octets = _Parts(len(fps)), _places(fps)
    for at in range(len(fps) - 1):
        shared = (octets[at + 1 :] == octets[at]).sum(axis=1)
        near = at + 1 + np.flatnonzero(shared >= 8 - most)
        for other in near[_bits(fps[near] ^ fps[at]) <= most].tolist():
            if parts.join(at, other):
                yield at, other


def _looked_up(fps: np.ndarray, free: tuple[int, ...], most: int) -> Iterator[tuple[int, int]]:
    """Links of a list whose fingerprints differ in the ``free`` places only: each flip of up to ``most`` bits is looked up."""
    parts, order = _Parts(len(fps)), np.argsort(fps)
    ranked = fps[order]
    bits = [np.uint64(1 << (8 * p + b)) for p in free for b in range(8)]
    for size in range(1, most + 1):
        for flips in combinations(bits, size):
            wanted = ranked ^ np.bitwise_or.reduce(flips)
            at = np.minimum(np.searchsorted(ranked, wanted), len(ranked) - 1)
            for a in np.flatnonzero((ranked[at] == wanted) & (wanted > ranked)).tolist():
                if parts.join(a, int(at[a])):
                    yield int(order[a]), int(order[at[a]])


def _posted(fps: DataFrame, tasks: int) -> DataFrame:
    """(key, fp): every fingerprint in its eight lists, lists whole and sorted within tasks."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("fp").to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([_key(values, t) for t in _TRIPLES])), pa.array(np.tile(values.view(np.int64), len(_TRIPLES)))], names=["key", "fp"])

    return fps.mapInArrow(post, "key long, fp long").repartition(tasks, "key").sortWithinPartitions("key", "fp")


def links(fps: DataFrame, most: int = MAX_BITS, longest: int = LONGEST) -> DataFrame:
    """(u, v): links between distinct fingerprints ``fp`` at ``most`` or fewer differing bits that connect exactly
    those which any chain of such links connects. ``most`` is 3 at the largest, for which the lists are made."""
    if not 0 <= most <= 3:
        raise ValueError("the posting lists hold for up to 3 differing bits")
    tasks = tasks_for(fps.sparkSession)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches, ["key"]):
            values = rows.column("fp").to_numpy().view(np.uint64)
            starts = np.append(run_starts(rows, ["key"]), len(values))
            u, v, again_key, again_fp = [], [], [], []
            for run in np.flatnonzero(np.diff(starts) > 1).tolist():
                start, stop = starts[run], starts[run + 1]
                fps = values[start:stop]
                if stop - start <= longest:
                    for a, b in _tallied(fps, most):
                        u.append(fps[a])
                        v.append(fps[b])
                    continue
                mask = int(rows.column("key")[int(start)].as_py()) >> 24
                fixed = tuple(p for p in range(8) if mask >> p & 1)
                for more in combinations([p for p in range(8) if p not in fixed], 2):
                    again_key.append(_key(fps, tuple(sorted(fixed + more))))
                    again_fp.append(fps)
            u, v = np.array(u, dtype=np.uint64).view(np.int64), np.array(v, dtype=np.uint64).view(np.int64)
            if len(u):
                yield _linked(np.zeros(len(u), np.int64), u, v)
            if again_key:
                keys, members = np.concatenate(again_key), np.concatenate(again_fp).view(np.int64)
                yield _linked(np.ones(len(keys), np.int64), keys, members)

    first = settled(_posted(fps, tasks).mapInArrow(walk, "again long, u long, v long"))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches, ["key"]):
            values = rows.column("fp").to_numpy().view(np.uint64)
            starts = np.append(run_starts(rows, ["key"]), len(values))
            found = []
            for run in np.flatnonzero(np.diff(starts) > 1).tolist():
                fps = values[starts[run] : starts[run + 1]]
                mask = int(rows.column("key")[int(starts[run])].as_py()) >> 40
                free = tuple(p for p in range(8) if not mask >> p & 1)
                pairs = _tallied(fps, most) if len(fps) <= longest else _looked_up(fps, free, most)
                found += [(fps[a], fps[b]) for a, b in pairs]
            if found:
                both = np.array(found, dtype=np.uint64).view(np.int64)
                yield _linked(np.zeros(len(both), np.int64), both[:, 0], both[:, 1])

    again = first.filter("again = 1").select(F.col("u").alias("key"), F.col("v").alias("fp")).distinct()
    second = again.repartition(tasks, "key").sortWithinPartitions("key", "fp").mapInArrow(look_up, "again long, u long, v long")
    return first.filter("again = 0").unionByName(second).select("u", "v")


def _linked(again: np.ndarray, u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(again), pa.array(u), pa.array(v)], names=["again", "u", "v"])


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, most: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id): the group of each document, named by its smallest id.

    Exact copies and repeated rows share a fingerprint and cost one entry in the index. Null and wordless texts have
    fingerprint 0 and link like any other. A null id never names a group unless all its ids are null.
    """
    rows = settled(with_fingerprint(docs.select("doc_id", "text"), shingle).select("doc_id", "fp"))
    distinct = settled(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    labels = component_min(settled(links(distinct.select("fp"), most)))
    named = distinct.join(labels, distinct["fp"] == labels["node"], "left").select("fp", "low", F.coalesce("label", "fp").alias("label"))
    groups = named.groupBy("label").agg(F.min("low").alias("component_id"))
    of_fp = named.join(groups, "label").select("fp", "component_id")
    return rows.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, shingle: int = SHINGLE, most: int = MAX_BITS) -> DataFrame:
    """The document with the smallest id of each group, all its columns; of repeated rows one stays.

    A null id stands behind all others. If one id has several texts in a group, the text with the least hash stays.
    """
    found = near_duplicates(docs.select(F.struct(F.col("doc_id").isNull().alias("none"), *row_key()).alias("doc_id"), "text"), shingle, most)
    kept = found.filter("doc_id = component_id").select("doc_id.k0", "doc_id.k1").distinct()
    rest, back = carried(docs)
    unique = docs.select(rest, *row_key()).dropDuplicates(["k0", "k1"])
    return unique.join(kept, ["k0", "k1"], "left_semi").select(*back)
