"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram binds its letters' vectors, each rotated by its place, by
multiplication; a text bundles its n-grams by addition; a language prototype bundles all its texts. A document gets
the language whose prototype has the largest cosine with its own vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hotelspark.llm.quality import held_out

DIMENSIONS = 1024
GRAM = 3
#: N-gram vectors kept per task; the table is emptied when full, which costs time and changes nothing.
KEPT_GRAMS = 16_384
#: Texts of one language whose n-grams a task adds up before it binds them.
TOGETHER = 256
_FOLD = 1 << 21


class Space:
    """Letter and n-gram vectors, drawn from the code points alone, so every task makes the same ones."""

    def __init__(self, dimensions: int = DIMENSIONS, gram: int = GRAM):
        self.dimensions, self.gram = dimensions, gram
        self.letters: dict[int, np.ndarray] = {}
        self.places: dict[int, int] = {}
        self.table = np.zeros((1024, dimensions), dtype=np.float32)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) >= KEPT_GRAMS:
                self.letters.clear()
            bits = np.random.default_rng(code).integers(0, 2, self.dimensions)
            self.letters[code] = (2 * bits - 1).astype(np.float32)
        return self.letters[code]

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """One row per n-gram code."""
        missing = [g for g in grams.tolist() if g not in self.places]
        if len(self.places) + len(missing) > KEPT_GRAMS:
            self.places, missing = {}, grams.tolist()
        if len(self.places) + len(missing) > len(self.table):
            room = np.zeros((2 * (len(self.places) + len(missing)), self.dimensions), dtype=np.float32)
            room[: len(self.table)] = self.table[: len(room)]
            self.table = room
        for code in missing:
            at = self.places[code] = len(self.places)
            rest, bound = code, np.ones(self.dimensions, dtype=np.float32)
            for turn in range(self.gram):
                bound = bound * np.roll(self.letter(rest % _FOLD), turn)
                rest //= _FOLD
            self.table[at] = bound
        return self.table[[self.places[g] for g in grams.tolist()]]

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.zeros(self.dimensions)
        for at in range(0, len(grams), 8192):
            total += counts[at : at + 8192].astype(np.float32) @ self.vectors(grams[at : at + 8192])
        return total


def gram_counts(text: str | None, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Distinct letter n-grams of a whole text and how often each stands; case is folded, and everything between
    letters counts as one space. Both are empty if there is no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
    codes = np.where(_letters(codes), codes, 32)
    if not (codes != 32).any():
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    codes = np.concatenate(([32], codes, [32]))
    codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]
    packed = np.zeros(max(len(codes) - gram + 1, 0), dtype=np.int64)
    for place in range(gram):
        packed = packed * _FOLD + codes[place : place + len(packed)]
    return np.unique(packed, return_counts=True)


_ALPHABETIC = np.array([chr(c).isalpha() for c in range(0x3000)])


def _letters(codes: np.ndarray) -> np.ndarray:
    """Whether each code point is a letter."""
    low = codes < len(_ALPHABETIC)
    out = _ALPHABETIC[np.where(low, codes, 0)]
    if not low.all():
        high = np.flatnonzero(~low)
        out[high] = [chr(c).isalpha() for c in codes[high].tolist()]
    return out


def learn(docs: DataFrame, folds: int = 3, held: int = 1) -> dict[str, np.ndarray]:
    """Unit prototypes of the languages named in ``lang``, bundled over all rows outside the held-out fold.

    Bundling is a sum, so each task adds up its n-grams per language, and Spark adds the tasks' vectors. The driver
    gets one vector per language. Rows with null text or language are left out.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(folds, held)).select("lang", "text")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums, held = Space(), {}, {}

        def bundle(lang: str) -> None:
            """Distinct n-grams of many texts are bound once: the sum of the texts' bundles is the bundle of their sum."""
            grams, counts = (np.concatenate(x) for x in zip(*held.pop(lang), strict=True))
            grams, at = np.unique(grams, return_inverse=True)
            sums[lang] = sums.get(lang, 0) + space.bundle(grams, np.bincount(at, weights=counts))

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                grams, counts = gram_counts(text.as_py())
                if len(grams):
                    held.setdefault(lang, []).append((grams, counts))
                    if len(held[lang]) >= TOGETHER:
                        bundle(lang)
        for lang in list(held):
            bundle(lang)
        for lang, vector in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(vector)), pa.array(range(len(vector)), pa.int32()), pa.array(vector)], names=["lang", "at", "value"])

    parts = rows.mapInArrow(add_up, "lang string, at int, value double").groupBy("lang", "at").agg(F.sum("value").alias("value"))
    vectors = parts.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("all")).orderBy("lang").collect()
    out = {row["lang"]: np.array([x["value"] for x in row["all"]]) for row in vectors}
    return {lang: v / np.linalg.norm(v) for lang, v in out.items() if v.any()}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score``, the cosine with that prototype (0 if negative).

    ``und`` with score 0 where the text is null or has no letter, or no language was learned. Ties go to the first
    language in code-point order. Columns that already have these names are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    names = sorted(prototypes)
    stacked = np.stack([prototypes[n] for n in names]).T if names else None
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space()
        for batch in batches:
            found, scores = [], []
            for text in batch.column("text"):
                grams, counts = gram_counts(text.as_py())
                vector = space.bundle(grams, counts) if names and len(grams) else None
                if vector is None or not vector.any():
                    found.append("und")
                    scores.append(0.0)
                    continue
                cosines = vector @ stacked / np.linalg.norm(vector)
                best = int(np.argmax(cosines))
                found.append(names[best])
                scores.append(float(min(max(cosines[best], 0.0), 1.0)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                                             names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(compare, schema)
