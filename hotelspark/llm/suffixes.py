"""Suffix-array dedup by column-wise construction over many strings.

A repeat of at least ``length`` bytes is found in three steps.

1. Every window of ``length`` bytes has an anchor, its least hashed k-gram. Equal windows have equal anchors at the
   same place, so only runs of windows whose anchor stands twice can hold repeats. Equal runs are kept once, with
   their number.
2. A run is cut into short ones at fixed distances from the anchor. All windows of a short run share its core, the
   bytes between its last start and its first end; the core becomes one symbol, named by a 128-bit digest. What
   is left is a collection of strings of less than twice the run's width.
3. The collections' suffix order, Burrows-Wheeler transform and common prefixes are built by inserting one symbol
   per string and round (Bauer, Cox and Rosone 2013). A common prefix of ``width`` symbols is a repeated window.

A collection is bounded, so its columns stay in a task's memory; the sorted shuffle files bring them in sequence.
Cores that stand very often in different surroundings are dealt out again by shorter runs with longer cores, down to
single windows, so no core is gathered whole however often it stands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hotelspark.llm.common import carried, row_key, run_starts, settled, tasks_for, whole_runs

LENGTH = 400
#: Widths of runs: of an anchor at first, then of the collections, each a divisor of the one before.
WIDTHS = (200, 40, 8, 1)
#: Most parts around one core that are gathered in one task.
AROUND = 2048
#: Strings of a collection, cores kept whole.
COLLECTION = 512
#: Most cores with more parts that are broadcast; more are joined by a shuffle.
BROADCAST = 100_000
#: Bytes of texts whose anchors are sought at once.
BUFFER = 1 << 19

_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse; only those for usual buffers are kept."""
    room = max(1 << (size - 1).bit_length(), 1 << 16)
    return (_kept_powers if room <= 2 * BUFFER else _kept_powers.__wrapped__)(base, room)


@lru_cache(maxsize=8)
def _kept_powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        powers = np.full(size, b, dtype=np.uint64)
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return out[0], out[1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


class Hashes:
    """Hashes of any stretch of a buffer from prefix sums."""

    def __init__(self, buffer: np.ndarray, base: int):
        powers, self.inverse = _powers(base, len(buffer) + 1)
        self.sums = np.zeros(len(buffer) + 1, dtype=np.uint64)
        np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * powers[: len(buffer)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.inverse[start])

    def rolling(self, size: int) -> np.ndarray:
        """Hashes of all stretches of one size."""
        sums = self.sums[size:] - self.sums[: len(self.sums) - size]
        sums *= self.inverse[: len(sums)]
        return mixed(sums)


def anchored_runs(texts: list[bytes], length: int, width: int) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, run hash, first start, last start - first start, anchor - first start) of the runs of
    windows of ``length`` bytes that share an anchor, over whole texts."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    buffer = np.frombuffer(b"".join(texts), dtype=np.uint8)
    gram = length - width + 1
    counts = np.maximum(sizes - length + 1, 0)
    if not counts.any():
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(6))
    hashes = Hashes(buffer, _BASES[0])
    grams = hashes.rolling(gram)
    low = np.uint64((1 << len(buffer).bit_length()) - 1)
    padded = np.full(-(-len(grams) // width) * width + width, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.bitwise_or(grams & ~low, np.arange(len(grams), dtype=np.uint64), out=padded[: len(grams)])
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    behind = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    least = np.minimum(ahead[: len(buffer) - length + 1], behind[width - 1 : len(buffer) - length + width])
    text = np.repeat(np.arange(len(texts)), counts)
    window = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - starts, counts)
    place = (least[window] & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.append(first[1:], len(place)) - 1
    s0, s1, at, text = window[first], window[last], place[first], text[first]
    around = Hashes(buffer, _BASES[1]).of(s0, s1 + length)
    around = mixed(around + (at - s0).astype(np.uint64) * np.uint64(0x100000001B3) + (s1 - s0).astype(np.uint64))
    return text, grams[at].view(np.int64), around.view(np.int64), s0 - starts[text], s1 - s0, at - s0


def suffix_classes(strings: list[np.ndarray], weights: np.ndarray, width: int) -> list[np.ndarray]:
    """For each string, whether each window of ``width`` symbols stands at least twice in the weighted collection.

    Round j inserts the suffix of length j of every string that has one. The suffixes stand in order; each but the
    empty ones knows the place ``origin`` of the suffix it prolongs. Behind one first symbol the suffixes stand in the
    order of their origins, so a new one's place is a search by (symbol, origin), and its common prefix with a
    neighbour is one more than the least common prefix between the two origins.
    """
    total = len(strings)
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    symbols = np.zeros((total, int(sizes.max())), dtype=np.int64)
    for i, s in enumerate(strings):
        symbols[i, symbols.shape[1] - len(s) :] = s
    symbols = symbols[:, ::-1]
    # Empty suffixes come first; their key is -1 so that every symbol is larger.
    first, origin = np.full(total, -1, dtype=np.int64), np.arange(total, dtype=np.int64)
    owner, size, prefix = np.arange(total), np.zeros(total, dtype=np.int64), np.zeros(total, dtype=np.int64)
    at = np.arange(total)
    for round_ in range(symbols.shape[1]):
        active = np.flatnonzero(sizes > round_)
        symbol, source = symbols[active, round_], at[active]
        turn = np.lexsort((source, symbol))
        active, symbol, source = active[turn], symbol[turn], source[turn]
        place = np.searchsorted((first << 32) + origin, (symbol << 32) + source)
        count, new = len(first), len(active)
        before = np.cumsum(np.bincount(place, minlength=count + 1))[:count]
        old_to, new_to = np.arange(count) + before, place + np.arange(new)

        def merged(old: np.ndarray, added: np.ndarray, old_to=old_to, new_to=new_to) -> np.ndarray:
            out = np.empty(len(old) + len(added), dtype=np.int64)
            out[old_to], out[new_to] = old, added
            return out

        firsts, origins = merged(first, symbol), merged(origin, source)
        prefixes = merged(prefix, np.zeros(new, dtype=np.int64))
        touched = np.union1d(new_to, new_to + 1)
        touched = touched[(touched > 0) & (touched < count + new)]
        same = firsts[touched] == firsts[touched - 1]
        prefixes[touched[~same]] = 0
        touched = touched[same & (firsts[touched] >= 0)]
        if len(touched):
            bounds = np.stack((origins[touched - 1] + 1, origins[touched] + 1), axis=1).reshape(-1)
            prefixes[touched] = 1 + np.minimum.reduceat(np.append(prefix, 0), bounds)[::2]
        moved = np.append(old_to, 0)
        real = firsts >= 0
        origins[real] = moved[origins[real]]
        owner, size = merged(owner, active), merged(size, np.full(new, round_ + 1))
        first, origin, prefix = firsts, origins, prefixes
        at = old_to[at]
        at[active] = new_to
    group = np.cumsum(prefix < width)
    often = np.bincount(group, weights=weights[owner])[group] >= 2
    flags = [np.zeros(max(n - width + 1, 0), dtype=bool) for n in sizes.tolist()]
    for i in np.flatnonzero(often & (size >= width)).tolist():
        flags[owner[i]][sizes[owner[i]] - size[i]] = True
    return flags


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last index of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return [(int(a), int(b) - 1) for a, b in edges.reshape(-1, 2)]


def _anchors(docs: DataFrame, length: int, width: int) -> DataFrame:
    rows = docs.select(*row_key(), F.col("text").cast("binary").alias("text")).filter(F.octet_length("text") >= length)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            start = held = 0
            for i, text in enumerate(texts):
                held += len(text)
                if held >= BUFFER or i + 1 == len(texts):
                    at, anchor, run, *numbers = anchored_runs(texts[start : i + 1], length, width)
                    own = [batch.column(c).take(pa.array(at + start)) for c in ("k0", "k1")]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor), pa.array(run), *own, *[pa.array(x.astype(np.int32)) for x in numbers]],
                        names=["anchor", "run", "k0", "k1", "at", "more", "lead"])
                    start, held = i + 1, 0

    return rows.mapInArrow(find, "anchor long, run long, k0 long, k1 long, at int, more int, lead int")


_PARTS = "g0 long, g1 long, left binary, right binary, anchor long, run long, off int, number long"


def _digest(*parts: bytes) -> tuple[int, int]:
    found = hashlib.blake2b(b"".join(parts), digest_size=16).digest()
    return int.from_bytes(found[:8], "little", signed=True), int.from_bytes(found[8:], "little", signed=True)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)


def _part_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["g0", "g1", "left", "right", "anchor", "run", "off", "number"]
    return _batch(rows, names, [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64()])


def _cut(docs: DataFrame, runs: DataFrame, length: int, width: int) -> DataFrame:
    """The short runs of ``runs``, one text of each fetched from ``docs``."""
    wanted = runs.groupBy("k0", "k1").agg(F.collect_list(F.struct("anchor", "run", "number", "at", "more", "lead")).alias("runs"))
    keyed = docs.select(*row_key(), F.col("text").cast("binary").alias("text")).filter(F.octet_length("text") >= length)
    joined = keyed.join(wanted, ["k0", "k1"]).select("text", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column("text"), batch.column("runs"), strict=True):
                text = text.as_py()
                for run in found.as_py():
                    s0, s1, p = run["at"], run["at"] + run["more"], run["at"] + run["lead"]
                    for j in range((p - s1) // width, (p - s0) // width + 1):
                        low, high = max(s0, p - (j + 1) * width + 1), min(s1, p - j * width)
                        start, stop = p - j * width, p - (j + 1) * width + 1 + length
                        out.append((*_digest(text[start:stop]), text[low:start], text[stop : high + length],
                                    run["anchor"], run["run"], low - s0, run["number"]))
                if len(out) >= 5000:
                    yield _part_batch(out)
                    out = []
            yield _part_batch(out)

    return joined.mapInArrow(cut, _PARTS)


def _cut_again(parts: DataFrame, width: int, narrow: int) -> DataFrame:
    """``parts`` of runs of ``width`` as parts of runs of ``narrow``; the longer core takes in what stood around the old one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                left, right = row["left"], row["right"]
                core = row["g0"].to_bytes(8, "little", signed=True) + row["g1"].to_bytes(8, "little", signed=True)
                windows = len(left) + len(right) + 2 - width
                for j in range((len(left) - windows + 1) // narrow, len(left) // narrow + 1):
                    low, high = max(0, len(left) - (j + 1) * narrow + 1), min(windows - 1, len(left) - j * narrow)
                    start, stop = len(left) - j * narrow, width - (j + 1) * narrow
                    digest = _digest(core, j.to_bytes(2, "little"), left[start:], right[:stop])
                    out.append((*digest, left[low:start], right[stop : high - len(left) + width - 1], row["anchor"], row["run"], row["off"] + low, row["number"]))
            yield _part_batch(out)

    return parts.mapInArrow(cut, _PARTS)


def _found(table: pa.Table, width: int) -> pa.RecordBatch:
    """The repeated windows of whole cores, sorted by core and string, as ranges of starts in their runs."""
    cores, total = run_starts(table, ["g0", "g1"]), table.num_rows
    left, right = (table.column(c).combine_chunks() for c in ("left", "right"))
    number, off = table.column("number").to_numpy(), table.column("off").to_numpy().astype(np.int64)
    new = np.zeros(total, dtype=bool)
    new[cores] = True
    for column in (left, right):
        new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    core = np.repeat(np.arange(len(cores)), np.diff(np.append(cores, total)))
    kinds, often = np.add.reduceat(new.astype(np.int64), cores), np.add.reduceat(number, cores) > 1
    # Alone around its core, a string repeats whole.
    alone = np.flatnonzero((often & (kinds == 1))[core])
    ends = pc.binary_length(left).to_numpy().astype(np.int64) + pc.binary_length(right).to_numpy() + 1 - width
    rows, low, high = [alone], [np.zeros(len(alone), dtype=np.int64)], [ends[alone]]
    strings = np.flatnonzero(new)
    weights, copies = np.add.reduceat(number, strings), np.diff(np.append(strings, total))
    several = np.flatnonzero((kinds > 1)[core[strings]])
    at = core[strings[several]]
    done = 0
    while done < len(several):
        # Whole cores, until there are COLLECTION strings.
        stop = int(np.searchsorted(at, at[min(done + COLLECTION, len(several)) - 1], side="right"))
        chosen, done = several[done:stop], stop
        first = pa.array(strings[chosen])
        symbols = (256 + core[strings[chosen]] - core[strings[chosen[0]]]).tolist()
        collection = [np.concatenate((np.frombuffer(a, dtype=np.uint8), [c], np.frombuffer(b, dtype=np.uint8)))
                      for a, b, c in zip(left.take(first).to_pylist(), right.take(first).to_pylist(), symbols, strict=True)]
        for i, flags in zip(chosen.tolist(), suffix_classes(collection, weights[chosen], width), strict=True):
            for a, b in _ranges(flags):
                rows.append(np.arange(strings[i], strings[i] + copies[i]))
                low.append(np.full(copies[i], a, dtype=np.int64))
                high.append(np.full(copies[i], b, dtype=np.int64))
    row = np.concatenate(rows)
    own = [table.column(c).to_numpy()[row] for c in ("anchor", "run")]
    bounds = [(np.concatenate(x) + off[row]).astype(np.int32) for x in (low, high)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (*own, *bounds)], names=["anchor", "run", "a", "b"])


def _repeated(parts: DataFrame, width: int) -> DataFrame:
    """(anchor, run, a, b): the repeated windows of each part, as ranges of starts in its run."""
    rows = parts.repartition(tasks_for(parts.sparkSession), "g0", "g1").sortWithinPartitions("g0", "g1", "left", "right")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ["g0", "g1"]):
            yield _found(table, width)

    return rows.mapInArrow(build, "anchor long, run long, a int, b int")


def _crowded(parts: DataFrame) -> tuple[DataFrame, int, int]:
    """(g0, g1, alone) of the cores with more than ``AROUND`` parts, whether all of these are the same string; the
    number of such cores, and of those with several strings."""
    string = F.xxhash64("left", "right")
    crowd = settled(parts.groupBy("g0", "g1").agg(F.count(F.lit(1)).alias("n"), (F.min(string) == F.max(string)).alias("alone"))
                    .filter(F.col("n") > AROUND).select("g0", "g1", "alone"))
    return crowd, *crowd.agg(F.count(F.lit(1)), F.count(F.expr("nullif(alone, true)"))).first()


def repeats(docs: DataFrame, length: int = LENGTH, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """(k0, k1, found): per document key the ranges of starts of windows of ``length`` bytes that also start elsewhere.

    Texts are UTF-8 bytes, whole; null or shorter texts have no window. Repeated rows repeat all their windows.
    """
    anchors = _anchors(docs, length, widths[0])
    # Settled, so that the join below has two plain shuffles, whose hot keys Spark can split.
    often = settled(anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), (F.min("run") == F.max("run")).alias("alone"))
                    .filter("n > 1").select("anchor", "alone"))
    places = settled(anchors.join(often, "anchor"))
    # Alone at its anchor, a run repeats whole: no window of another run can equal one of it.
    whole = places.filter("alone").select("k0", "k1", F.col("at").alias("a"), F.expr("at + more").alias("b"))
    places = places.filter("NOT alone").drop("alone")
    runs = places.groupBy("anchor", "run").agg(
        F.count(F.lit(1)).alias("number"), F.min(F.struct("k0", "k1", "at", "more", "lead")).alias("one")).select("anchor", "run", "number", "one.*")
    parts = settled(_cut(docs, runs, length, widths[1]))
    found = []
    for width, narrow in zip(widths[1:], [*widths[2:], 0], strict=True):
        crowd, cores, several = _crowded(parts)
        if not cores:
            found.append(_repeated(parts, width))
            break
        marked = parts.join(F.broadcast(crowd) if cores <= BROADCAST else crowd, ["g0", "g1"], "left")
        found.append(_repeated(marked.filter("alone IS NULL").select(*parts.columns), width))
        ends = F.col("off") + F.octet_length("left") + F.octet_length("right") + 1 - width
        found.append(marked.filter("alone").select("anchor", "run", F.col("off").alias("a"), ends.alias("b")))
        if not several:
            break
        parts = settled(_cut_again(marked.filter("NOT alone").select(*parts.columns), width, narrow))
    of_runs = reduce(DataFrame.unionByName, found)
    ranges = places.join(of_runs, ["anchor", "run"]).select("k0", "k1", F.expr("a + at").alias("a"), F.expr("b + at").alias("b"))
    return ranges.unionByName(whole).groupBy("k0", "k1").agg(F.collect_set(F.struct("a", "b")).alias("found"))


def spans(starts: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal covered stretches [from, to) of the windows that start in the given ranges."""
    out: list[list[int]] = []
    for a, b in sorted((x["a"], x["b"] + length) for x in starts or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _with_repeats(docs: DataFrame, length: int, widths: tuple[int, ...]) -> tuple[DataFrame, list]:
    """(carried, text, found): every row with its repeats, and the expressions of the original columns."""
    rest, back = carried(docs, "text")
    rows = docs.select(rest, "text", *row_key()).join(repeats(docs, length, widths), ["k0", "k1"], "left")
    return rows.select("carried", "text", "found"), back


def measure_repeats(docs: DataFrame, length: int = LENGTH, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document after its repeated bytes are removed."""
    rows = _with_repeats(docs.select("doc_id", "text"), length, widths)[0].select("carried.doc_id", "text", "found")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, starts in zip(*(batch.column(c) for c in ("doc_id", "text", "found")), strict=True):
                text = (text.as_py() or "").encode()
                gone, kept, end = spans(starts.as_py(), length), hashlib.sha256(), 0
                for a, b in gone:
                    kept.update(text[end:a])
                    end = b
                kept.update(text[end:])
                out.append((doc.as_py(), len(text), sum(b - a for a, b in gone), len(gone), kept.hexdigest()))
            yield _batch(out, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], [pa.int64()] * 4 + [pa.string()])

    return rows.mapInArrow(measure, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def strip_repeats(docs: DataFrame, length: int = LENGTH, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """``docs`` with every character removed whose bytes all stand in a repeat; characters cut by an end of one stay."""
    rows, back = _with_repeats(docs, length, widths)
    schema = T.StructType(rows.schema.fields[:2])

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, starts in zip(batch.column("text"), batch.column("found"), strict=True):
                text = text.as_py()
                gone = spans(starts.as_py(), length)
                if gone:
                    octets, kept, end = text.encode(), [], 0
                    for a, b in gone:
                        while a < b and octets[a] & 0xC0 == 0x80:
                            a += 1
                        while b < len(octets) and b > a and octets[b] & 0xC0 == 0x80:
                            b -= 1
                        kept.append(octets[end:a])
                        end = b
                    text = b"".join([*kept, octets[end:]]).decode()
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("carried"), pa.array(texts, pa.string())], names=["carried", "text"])

    return rows.mapInArrow(strip, schema).select(*back)
