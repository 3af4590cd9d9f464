"""Quality classifier: regularised quadratic discriminant over transformed statistics of whole documents.

Each class has a mean and a covariance shrunk towards the pooled one and towards a sphere. A score is the
difference of the two Mahalanobis log densities, computed from Cholesky factors that the model keeps, as a posterior.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEATURES = ("log_word_length", "symbols", "upper", "stops", "distinct_words", "entropy")
POOLED = 0.6
SPHERE = 0.02
ACCEPT = 0.3

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
_STOP = np.isin(_BYTES, np.frombuffer(b".,;:!?'\"-()", dtype=np.uint8))
_SYMBOL = (_BYTES < 128) & ~(_UPPER | _LOWER | _DIGIT | _SPACE | _STOP)


def statistics(text: bytes | None) -> np.ndarray:
    """The transformed statistics of one whole text: logs of counts and angles of shares. Null counts as empty.

    An angle is the arc sine of a share's root: its spread hardly depends on the share, and a share of zero is zero in
    short texts as in long ones.
    """
    text = text or b""
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    words = text.split()
    total, spaces = len(text), counts[_SPACE].sum()
    inked = total - spaces

    def angle(part: float, whole: float) -> float:
        return float(np.arcsin(np.sqrt(part / whole))) if whole else 0.0

    shares = counts[counts > 0] / max(total, 1)
    return np.array([
        np.log1p(inked / max(len(words), 1)), angle(counts[_SYMBOL].sum(), inked), angle(counts[_UPPER].sum(), inked),
        angle(counts[_STOP].sum(), inked), angle(len(set(words)), len(words)), float(-(shares * np.log(shares)).sum()),
    ])


def feature_rows(docs: DataFrame, *keep: str) -> DataFrame:
    """The ``keep`` columns and the array ``features`` of every row's whole text."""
    rows = docs.select(*keep, F.col("text").cast("binary").alias("_text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("features", T.ArrayType(T.DoubleType()))])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(x.as_py()) for x in batch.column("_text")]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(found, pa.list_(pa.float64()))], names=[*batch.schema.names[:-1], "features"])

    return rows.mapInArrow(measure, schema)


@dataclass(frozen=True)
class Discriminant:
    """Per class (0, 1): mean, inverse Cholesky factor, log determinant and log prior; ``constant`` where a class is missing."""

    means: tuple
    factors: tuple
    offsets: tuple
    constant: float | None = None

    def score(self, features: np.ndarray) -> np.ndarray:
        """Posterior of class 1, from 0 to 1."""
        if self.constant is not None:
            return np.full(len(features), self.constant)
        density = [offset - 0.5 * np.square((features - mean) @ factor.T).sum(axis=1)
                   for mean, factor, offset in zip(self.means, self.factors, self.offsets, strict=True)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -700, 700)))


def fit(rows: DataFrame, pooled: float = POOLED, sphere: float = SPHERE) -> Discriminant:
    """Fit on all ``rows(label, features)``; labels other than 0 and 1 are left out.

    Counts, sums and products are added up by Spark; the driver gets at most two rows per pair of features. Without
    labelled rows of both classes the score is constant: the share of class 1, or 0.5 without any row.
    """
    names = range(len(FEATURES))
    f = [F.col("features")[i] for i in names]
    sums = rows.filter("label IN (0, 1)").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f[i]).alias(f"s{i}") for i in names],
        *[F.sum(f[i] * f[j]).alias(f"p{i}_{j}") for i in names for j in names if i <= j]).collect()
    found = {row["label"]: row for row in sums}
    total = sum(row["n"] for row in sums)
    if len(found) < 2:
        return Discriminant((), (), (), (found[1]["n"] / total if 1 in found else 0.0) if total else 0.5)
    means, spreads, counts = [], [], []
    for label in (0, 1):
        row = found[label]
        mean = np.array([row[f"s{i}"] for i in names]) / row["n"]
        products = np.array([[row[f"p{min(i, j)}_{max(i, j)}"] for j in names] for i in names]) / row["n"]
        means.append(mean)
        spreads.append(products - np.outer(mean, mean))
        counts.append(row["n"])
    both = (counts[0] * spreads[0] + counts[1] * spreads[1]) / total
    scale = np.sqrt(np.maximum(np.diag(both), 1e-6))
    factors, offsets = [], []
    for label in (0, 1):
        unit = ((1 - pooled) * spreads[label] + pooled * both) / np.outer(scale, scale)
        shrunk = (1 - sphere) * unit + sphere * max(np.trace(unit) / len(unit), 1e-3) * np.eye(len(unit))
        lower = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(lower) / scale)
        offsets.append(float(np.log(counts[label] / total) - np.log(np.diag(lower)).sum()))
    return Discriminant(tuple(means), tuple(factors), tuple(offsets))


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> Discriminant:
    """Fit on the labelled documents whose ``crc32(doc_id as text) mod folds`` is not ``held``; repeated rows count as often as they stand."""
    marks = labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("label"))
    learned = docs.filter(F.col("doc_id").isNotNull() & ~held_out(folds, held))
    return fit(feature_rows(learned, "doc_id").join(marks, "doc_id"))


def held_out(folds: int, held: int):
    """Whether a row's id falls in the held-out fold; a missing id counts as the text ''."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == held


def _scores(batch: pa.RecordBatch, model: Discriminant) -> np.ndarray:
    texts = batch.column("text").cast(pa.binary())
    return model.score(np.stack([statistics(x.as_py()) for x in texts])) if batch.num_rows else np.zeros(0)


def score_documents(docs: DataFrame, model: Discriminant, accept: float = ACCEPT) -> DataFrame:
    """All columns of ``docs`` with ``score`` (class 1 likelier when higher) and ``predicted`` (1 if at least ``accept``).

    Whole texts are measured; null and empty texts get the score of an empty text. Columns that already have these
    names are replaced.
    """
    docs = docs.drop("score", "predicted")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _scores(batch, model)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score), pa.array((score >= accept).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(judge, schema)


def accepted(docs: DataFrame, model: Discriminant, accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``accept``, all columns as they are."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch, model) >= accept))

    return docs.mapInArrow(choose, docs.schema)
