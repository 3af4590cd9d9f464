"""Best-fit packing by sums of squares: a document goes where the squared counts of open sequences per residual gap
add up to least, which keeps every gap equally rare and so finds partners for all sizes.

Documents are tokenised once; only those longer than a sequence are cut. Pieces are dealt by hash into groups of a
bounded number, and each group is packed by itself, so no task sees more than its group.
"""

from __future__ import annotations

import base64
import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotelspark.llm.common import row_key, run_starts, settled, whole_runs

LENGTH = 2048
END = 0
#: Pieces packed together. More pieces fill sequences better; the memory of a task grows with them.
GROUP = 50_000
#: Words whose ids a task keeps; the table is emptied when full.
KEPT_WORDS = 600_000

#: Share of a group's ids that is placed last, by best fit: no piece follows that would need the gaps left open.
CLOSING = 0.1

_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, dtype="<u4").tobytes()


class Words(dict):
    """Little-endian 32-bit ids of `` word``, remembered. A word that touches other white space is refused."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise LookupError
        if len(self) >= KEPT_WORDS:
            self.clear()
        found = self[word] = _packed(self.encode(" " + word))
        return found


class Tokens:
    """Ids of whole texts under a byte-level BPE vocabulary, as little-endian 32-bit integers.

    The vocabulary's own splitting never joins two words over a single space, so texts are cut there, and each
    distinct word is encoded once. ``added`` gives the ids of the tokens that stand outside the merges: ``text_ids``
    reads them wherever they stand in a text, while ``ids`` takes all of it as ordinary text.
    """

    def __init__(self, ranks_path: str, pattern: str, added: dict[str, int] | None = None):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.words = Words(self.encode)
        self.added = {token: number.to_bytes(4, "little") for token, number in (added or {}).items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.added else None

    def text_ids(self, text: str) -> bytes:
        """Ids with the added tokens read; what stands between two of them is encoded by itself."""
        if not any(token in text for token in self.added):
            return self.ids(text)
        return b"".join(self.added[part] if i % 2 else self.ids(part) for i, part in enumerate(self.marks.split(text)))

    def ids(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        try:
            if rest and (not first or first[-1].isspace()):
                raise LookupError
            return self._bytes(first) + b"".join(map(self.words.__getitem__, rest))
        except LookupError:
            first, *rest = _BETWEEN.split(text)
            return self._bytes(first) + b"".join(self.words[w] if not (w[0].isspace() or w[-1].isspace()) else self._bytes(" " + w) for w in rest)

    def _bytes(self, text: str) -> bytes:
        return _packed(self.encode(text)) if text else b""


def added_tokens(ranks_path: str) -> dict[str, int]:
    """The added tokens of the JSON tokenizer of the same name beside a rank file; none if there is no such file."""
    path = os.path.splitext(ranks_path)[0] + ".json"
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as file:
        found = json.load(file)["added_tokens"]
    if odd := [t["content"] for t in found if t["lstrip"] or t["rstrip"] or t["single_word"]]:
        raise ValueError(f"added tokens that depend on their surroundings are not supported: {odd}")
    return {t["content"]: t["id"] for t in found}


@lru_cache(maxsize=2)
def tokens(ranks_path: str | None = None) -> Tokens:
    """The public 50k byte-level vocabulary unless another file of ranks is named; read once per Python worker."""
    import public_tokenizers

    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return Tokens(path, public_tokenizers.PATTERN, added_tokens(path))


def pieces(docs: DataFrame, length: int = LENGTH, ranks_path: str | None = None) -> DataFrame:
    """(doc_id, k0, k1, piece, start, length, ids_crc32): the pieces of each document's ids and the end id.

    Documents of at most ``length`` ids are one piece. Longer ones are cut into pieces of exactly ``length``, of
    which the first may be shorter. Null text counts as empty: its only id is the end. Added tokens of the vocabulary
    that stand in a text, such as ``<|endoftext|>``, get their own ids.
    """
    rows = docs.select("doc_id", *row_key(), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokens(ranks_path)
        for batch in batches:
            at, number, start, size, crc = [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                ids = known.text_ids(text.as_py() or "") + END.to_bytes(4, "little")
                total = len(ids) // 4
                edges = [0, *range(total % length or length, total + 1, length)]
                for n, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    at.append(i)
                    number.append(n)
                    start.append(a)
                    size.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * b]))
            own = [batch.column(c).take(pa.array(at, pa.int64())) for c in ("doc_id", "k0", "k1")]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(number, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, size, crc)]],
                names=["doc_id", "k0", "k1", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(cut, "doc_id long, k0 long, k1 long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(sizes: list[int], capacity: int, closing: float = CLOSING) -> tuple[list[int], list[int]]:
    """(bin, place in it) of each size, taken in the given order.

    ``open_at[g]`` counts open bins with gap g. A size s in a gap g changes the sum of squares by
    2 (open_at[g - s] - open_at[g]) + 2; in a new bin by 2 open_at[capacity - s] + 1; closing a bin by 1 - 2 open_at[s].
    The least change wins, and of equal ones the smallest gap. The last ``closing`` share of the total goes into the
    smallest gap that holds it.
    """
    squares_end, done = (1 - closing) * sum(sizes), 0
    open_at = np.zeros(capacity + 1, dtype=np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    bins, places = [], []
    for s in sizes:
        if done < squares_end:
            change = 2 * (open_at[: capacity + 1 - s] - open_at[s:]) + 2
            change[0] = 1 - 2 * open_at[s]
            change[open_at[s:] == 0] = np.iinfo(np.int64).max
            change[-1] = 2 * open_at[capacity - s] + 1 if s < capacity else 0
            gap = s + int(np.argmin(change))
        else:
            held = open_at[s:capacity] > 0
            gap = s + int(np.argmax(held)) if held.any() else capacity
        done += s
        if gap == capacity:
            bins.append(len(fill))
            places.append(0)
            fill.append(s)
        else:
            chosen = waiting[gap].pop()
            open_at[gap] -= 1
            bins.append(chosen)
            places.append(fill[chosen])
            fill[chosen] += s
        left = capacity - fill[bins[-1]]
        if left:
            waiting[left].append(bins[-1])
            open_at[left] += 1
    return bins, places


def pack(rows: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``rows`` of pieces with ``sequence_id`` and ``offset``, each piece's sequence and its place there.

    A group takes its pieces by decreasing length, which leaves the small ones to fill the last gaps; equal lengths
    go by their keys, so a rerun packs alike.
    """
    groups = max(1, -(-rows.count() // group))
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("k0", "k1", "piece", "ids_crc32"), F.lit(groups)))
    sorted_rows = dealt.repartition(min(groups, 10_000), "group").sortWithinPartitions(
        "group", F.desc("length"), "k0", "k1", "piece")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in whole_runs(batches, ["group"]):
            starts = np.append(run_starts(found, ["group"]), found.num_rows)
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                part = found.slice(a, b - a)
                bins, places = sum_of_squares(part.column("length").to_pylist(), length)
                base = part.column("group")[0].as_py() << 32
                part = part.drop_columns(["group"])
                part = part.append_column("sequence_id", pa.array(base + np.array(bins, dtype=np.int64)))
                yield from part.append_column("offset", pa.array(places, pa.int64())).combine_chunks().to_batches()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return sorted_rows.mapInArrow(fill, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, length: int = LENGTH, group: int = GROUP, ranks_path: str | None = None) -> DataFrame:
    """The pieces of all documents with their sequences; see ``pieces`` and ``pack``."""
    return pack(settled(pieces(docs, length, ranks_path)), length, group)
