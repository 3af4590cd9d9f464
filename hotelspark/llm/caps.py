"""Embedding near-dedup with spherical-cap filters.

Filter directions are the words of a random product code: a vector is split into blocks, each block has its own few
random unit vectors, and any choice of one per block is a direction (Becker, Ducas, Gama and Laarhoven 2016). Each
vector is list-decoded, block by block and without going through the whole code, to all directions that could be best
for the middle between it and a vector at the least cosine. The best direction of a pair's middle thus stands in both
lists: vectors that share a direction and a label meet there, and their cosine is verified. No pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotelspark.llm.common import component_min, run_starts, settled, tasks_for, whole_runs
from hotelspark.llm.vectors import stacked, usable

COSINE = 0.98
BLOCKS = 2
WORDS = 181
#: Longer vectors lie near so many cells that lists save nothing: those of one label are all compared, in blocks.
LONGEST = 80
#: Added to the squared distance up to which cells are listed; far above the rounding of products.
ROUNDING = 1e-12
#: Vectors of one direction and label that are compared at once; larger ones are compared in blocks.
TOGETHER = 512


@lru_cache(maxsize=8)
def code(dimensions: int, blocks: int = BLOCKS, words: int | None = None) -> list[tuple[slice, np.ndarray]]:
    """Per block its components and its unit vectors, scaled so that a direction has length 1.

    Unless named, their number is less for blocks of few components, and one for vectors longer than ``LONGEST``.
    """
    edges = np.linspace(0, dimensions, min(blocks, dimensions) + 1).round().astype(int)
    rng, out = np.random.default_rng(dimensions), []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        few = 2 ** min(b - a, 16)
        vectors = rng.standard_normal((words or (min(WORDS, few) if dimensions <= LONGEST else 1), b - a))
        out.append((slice(a, b), vectors / np.linalg.norm(vectors, axis=1, keepdims=True) / np.sqrt(len(edges) - 1)))
    return out


def below_best(products: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """How far each word's product stays below the best one of its block."""
    return products.max(axis=1, keepdims=True) - products


def to_cell(products: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """At most the squared distance from each row to the points for which a word is the best of its block: such a point
    lies beyond the plane between the word and any other one."""
    apart = np.linalg.norm(vectors[:, None] - vectors, axis=2)
    per_length = np.divide(1, apart, out=np.zeros_like(apart), where=apart > 0)
    far = np.zeros_like(products)
    for other in range(len(vectors)):
        np.maximum(far, (products[:, other, None] - products) * per_length[other], out=far)
    return far**2


def decode(units: np.ndarray, limit: float, loss=below_best) -> tuple[np.ndarray, np.ndarray]:
    """(row, direction) of all directions whose losses of all blocks add up to at most ``limit``, by row and direction."""
    row, word, lost = np.arange(len(units)), np.zeros(len(units), dtype=np.int64), np.zeros(len(units))
    for part, vectors in code(units.shape[1]):
        own = loss(units[:, part] @ vectors.T, vectors)
        total = lost[:, None] + own[row]
        at, pick = np.nonzero(total <= limit)
        row, word, lost = row[at], word[at] * len(vectors) + pick, total[at, pick]
    turn = np.lexsort((word, row))
    return row[turn], word[turn]


def meeting_directions(units: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, direction) of all directions that may be best for the middle of a unit vector and one at cosine ``least``
    or more: that middle is at most sqrt((1 - least) / 2) away."""
    return decode(units, max(0.0, (1 - least) / 2) + ROUNDING, to_cell)


def at_best_of_middle(units: np.ndarray, left: np.ndarray, right: np.ndarray, word: int) -> np.ndarray:
    """Whether ``word`` is the best direction of the middle of each pair of rows, of equal ones the first. Products are
    summed in one fixed order, so a pair has the same best direction wherever it meets."""
    best = np.ones(len(left), dtype=bool)
    for part, vectors in reversed(code(units.shape[1])):
        word, own = divmod(word, len(vectors))
        products = np.zeros((len(units), len(vectors)))
        for mine, theirs in zip(units[:, part].T, vectors.T, strict=True):
            products += mine[:, None] * theirs
        for start in range(0, len(left), 16384):
            some = slice(start, start + 16384)
            best[some] &= (products[left[some]] + products[right[some]]).argmax(axis=1) == own
    return best


def _distinct(rows: DataFrame, label: str) -> DataFrame:
    """One row per label and vector: its hashes, number and smallest id, which stands for it."""
    return rows.groupBy("h0", "h1", "h2", label, "embedding").agg(F.count(F.lit(1)).alias("number"), F.min("vec_id").alias("node"))


def _directions(vectors: DataFrame, least: float, wide: bool) -> DataFrame:
    """A row per vector and direction: (lab, word, node) and, if ``wide``, all that verification needs."""
    rows = vectors.select(F.col("h0").alias("lab"), "node", "number", "embedding", F.size("embedding").alias("dims")).repartition(
        tasks_for(vectors.sparkSession), "node")
    kind = rows.schema["embedding"].dataType.simpleString()
    schema = "lab long, word long, node long" + (f", number long, embedding {kind}" if wide else "")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims):
                own = batch.filter(pa.array(dims == d))
                for start in range(0, own.num_rows, 1024):
                    part = own.slice(start, 1024)
                    matrix = stacked(part.column("embedding"))
                    at, word = meeting_directions(matrix / np.linalg.norm(matrix, axis=1, keepdims=True), least)
                    # Vectors of other lengths never meet: the length is part of the direction.
                    word = word + (int(d) << 40)
                    take = pa.array(at)
                    columns = [part.column("lab").take(take), pa.array(word), part.column("node").take(take)]
                    if wide:
                        columns += [part.column("number").take(take), part.column("embedding").take(take)]
                    yield pa.RecordBatch.from_arrays(columns, names=["lab", "word", "node", "number", "embedding"][: len(columns)])

    return rows.mapInArrow(spread, schema)


def _compared(matrix: np.ndarray, numbers: np.ndarray, word: int, side: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Per member its links found here and the first member of its part. ``side``: 0 and 1 compare with each other
    only, 2 with all. A pair that shares several directions is counted at the best one of its middle."""
    size = np.linalg.norm(matrix, axis=1)
    near = matrix @ matrix.T / (size[:, None] * size) >= least
    near &= (side[:, None] == 2) | (side[:, None] != side)
    left, right = np.nonzero(np.triu(near | near.T, 1))
    near = np.zeros_like(near)
    if len(left):
        members, at = np.unique(np.concatenate((left, right)), return_inverse=True)
        here = at_best_of_middle(matrix[members] / size[members, None], at[: len(left)], at[len(left) :], word & ((1 << 40) - 1))
        near[left[here], right[here]] = near[right[here], left[here]] = True
    part = np.arange(len(numbers))
    while near.any():
        low = np.minimum(part, np.where(near, part, len(part)).min(axis=1))
        low = low[low]
        if (low == part).all():
            break
        part = low
    return near @ numbers, part


def linked(vectors: DataFrame, least: float, together: int) -> DataFrame:
    """(node, links, root) for all distinct ``vectors``: links found at one direction, and a node of the same component."""
    crowded = _directions(vectors, least, wide=False).groupBy("lab", "word").agg(F.count(F.lit(1)).alias("n")).filter(f"n > {together}")
    rows = _directions(vectors, least, wide=True).join(settled(crowded), ["lab", "word"], "left")
    blocks = F.coalesce(F.ceil(F.col("n") / together), F.lit(1)).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "lab", "word", F.expr("least(own, other) * blocks + greatest(own, other)").alias("cell"),
        F.expr("case when own = other then 2 when own < other then 0 else 1 end").alias("side"), "node", "number", "embedding")
    dealt = rows.repartition(tasks_for(vectors.sparkSession), "lab", "word", "cell").sortWithinPartitions("lab", "word", "cell", "node")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ["lab", "word", "cell"], 4096):
            starts = np.append(run_starts(table, ["lab", "word", "cell"]), table.num_rows)
            nodes, numbers, sides = (table.column(c).to_numpy() for c in ("node", "number", "side"))
            found = []
            for run in np.flatnonzero(np.diff(starts) > 1).tolist():
                part = slice(starts[run], starts[run + 1])
                own = table.slice(starts[run], starts[run + 1] - starts[run])
                links, root = _compared(stacked(own.column("embedding")), numbers[part], own.column("word")[0].as_py(), sides[part], least)
                here = np.flatnonzero(links)
                found.append((nodes[part][here], links[here], nodes[part][root[here]]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found, strict=True)], names=["node", "links", "root"])

    return dealt.mapInArrow(verify, "node long, links long, root long")


def near_duplicates(rows: DataFrame, label: str = "label", least: float = COSINE, together: int = TOGETHER) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Rows with a null label, id or unusable vector have no links and stand alone; a null id has a null component and
    is not kept. Equal vectors of one label are compared once and count with their number. Vectors of different
    lengths never link. All pairs of at least the cosine ``least`` are found. Rows that repeat an id are one vertex of the components.
    """
    keyed = rows.select("vec_id", label, "embedding").withColumns({
        "h0": F.xxhash64(F.col(label)), "h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.size("embedding"), F.reverse("embedding")),
        "part": usable() & F.col(label).isNotNull() & F.col("vec_id").isNotNull()})
    vectors = settled(_distinct(keyed.filter("part"), label))
    found = settled(linked(vectors, least, together).groupBy("node", "root").agg(F.sum("links").alias("links")))
    labels = component_min(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    per_vector = vectors.select("h0", "h1", "h2", "node", "number").join(links, "node", "left").join(labels, "node", "left").select(
        "h0", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("number") - 1).alias("n_links"), F.coalesce("label", "node").alias("component_id"))
    ids = keyed.select("vec_id", "part", "h0", "h1", "h2").alias("r").join(
        per_vector.alias("p"), (F.col("r.h0") == F.col("p.h0")) & (F.col("r.h1") == F.col("p.h1")) & (F.col("r.h2") == F.col("p.h2")) & F.col("r.part"), "left")
    component = F.coalesce("component_id", "vec_id")
    return ids.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
