"""Approximate nearest neighbours with learned partitions.

A sample's neighbour graph is cut into parts of nearly equal size; a small network learns which part a vector's
neighbours lie in (Dong, Indyk, Razenshteyn and Wagner 2020). Every row is indexed in its most probable part; a query
goes to its several most probable ones, and all their rows are ranked by the exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hotelspark.llm.common import run_starts, settled, tasks_for, whole_runs
from hotelspark.llm.vectors import stacked, usable

#: Rows whose neighbour graph is partitioned and learned; the rest of the table is indexed, not fitted.
SAMPLE = 6000
#: Rows a part should hold, and the most parts. More parts than the sample can tell apart are of no use.
PART_ROWS = 1500
MOST_PARTS = 256
NEIGHBOURS = 10
HIDDEN = 96
EPOCHS = 30
#: Share of the sample's true neighbours that the chosen number of parts must hold, measured on rows not learned from.
RECALL = 0.97
#: Rows and queries that one comparison takes.
ROW_BLOCK, QUERY_BLOCK = 4096, 1024


def _unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def neighbour_graph(units: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row."""
    out = []
    for start in range(0, len(units), 1000):
        products = units[start : start + 1000] @ units.T
        products[np.arange(len(products)), start + np.arange(len(products))] = -np.inf
        out.append(np.argpartition(-products, min(k, len(units) - 1) - 1, axis=1)[:, :k])
    return np.concatenate(out)


def balanced_parts(graph: np.ndarray, parts: int, slack: float = 0.05, sweeps: int = 12, seed: int = 0) -> np.ndarray:
    """A part for each row: grown from spread seeds, then rows move to the part of most of their neighbours while it has room."""
    size, rng = len(graph), np.random.default_rng(seed)
    room = int(np.ceil(size / parts * (1 + slack)))
    ends = np.concatenate((graph.ravel(), np.repeat(np.arange(size), graph.shape[1])))
    starts = np.concatenate((np.repeat(np.arange(size), graph.shape[1]), graph.ravel()))
    order = np.argsort(starts, kind="stable")
    ends, cuts = ends[order], np.searchsorted(starts[order], np.arange(size + 1))
    part, held = np.full(size, -1), np.zeros(parts, dtype=np.int64)
    queue = [(int(v), p) for p, v in enumerate(rng.permutation(size)[:parts])]
    for v, p in queue:
        if part[v] < 0 and held[p] < room:
            part[v] = p
            held[p] += 1
            queue += [(int(n), p) for n in ends[cuts[v] : cuts[v + 1]] if part[n] < 0]
    for v in np.flatnonzero(part < 0):
        part[v] = p = int(np.argmin(held))
        held[p] += 1
    for _ in range(sweeps):
        moved = 0
        for v in rng.permutation(size):
            votes = np.bincount(part[ends[cuts[v] : cuts[v + 1]]], minlength=parts).astype(float)
            votes[part[v]] += 0.5
            votes[(held >= room) & (np.arange(parts) != part[v])] = -1
            best = int(np.argmax(votes))
            if best != part[v]:
                held[part[v]] -= 1
                held[best] += 1
                part[v] = best
                moved += 1
        if moved < size // 200:
            break
    return part


@dataclass(frozen=True)
class Router:
    """A network of one hidden layer over unit vectors, and how many parts a query visits."""

    first: np.ndarray
    second: np.ndarray
    visits: int

    @property
    def parts(self) -> int:
        return self.second.shape[1]

    def scores(self, units: np.ndarray) -> np.ndarray:
        hidden = np.maximum(np.column_stack((units, np.ones(len(units)))) @ self.first, 0)
        return np.column_stack((hidden, np.ones(len(hidden)))) @ self.second


def _train(units: np.ndarray, targets: np.ndarray, hidden: int, epochs: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Weights by Adam on the cross entropy with soft targets."""
    rng = np.random.default_rng(seed)
    x = np.column_stack((units, np.ones(len(units))))
    weights = [rng.standard_normal((x.shape[1], hidden)) * np.sqrt(2.0), rng.standard_normal((hidden + 1, targets.shape[1])) / np.sqrt(hidden)]
    mean, square, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
            step += 1
            before = x[batch] @ weights[0]
            active = np.column_stack((np.maximum(before, 0), np.ones(len(batch))))
            out = active @ weights[1]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            off = (out / out.sum(axis=1, keepdims=True) - targets[batch]) / len(batch)
            slopes = [x[batch].T @ ((off @ weights[1][:-1].T) * (before > 0)), active.T @ off]
            for i, slope in enumerate(slopes):
                mean[i] = 0.9 * mean[i] + 0.1 * slope
                square[i] = 0.999 * square[i] + 0.001 * slope**2
                weights[i] -= 0.005 * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
    return weights[0], weights[1]


def fit_router(sample: np.ndarray, parts: int, recall: float = RECALL) -> Router:
    """Cut the sample's graph, learn the parts of the neighbours of four rows in five, and set the visits on the rest."""
    units = _unit(sample)
    if parts <= 1 or len(units) <= NEIGHBOURS:
        return Router(np.zeros((sample.shape[1] + 1, 1)), np.zeros((2, 1)), 1)
    graph = neighbour_graph(units, NEIGHBOURS)
    part = balanced_parts(graph, parts)
    targets = np.zeros((len(units), parts))
    np.add.at(targets, (np.repeat(np.arange(len(units)), graph.shape[1] + 1), part[np.column_stack((graph, np.arange(len(units))))].ravel()), 1 / (graph.shape[1] + 1))
    learned = np.arange(len(units)) % 5 != 0
    router = Router(*_train(units[learned], targets[learned], HIDDEN, EPOCHS), visits=parts)
    scores = router.scores(units)
    indexed = scores.argmax(axis=1)
    tested = np.flatnonzero(~learned)
    rank = np.argsort(np.argsort(-scores[tested], axis=1), axis=1)
    needed = np.take_along_axis(rank, indexed[graph[tested]], axis=1).ravel()
    visits = int(np.quantile(needed, recall, method="higher")) + 1
    return Router(router.first, router.second, visits)


def search(rows: DataFrame, is_query, k: int = 5, part_rows: int = PART_ROWS, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found rows by cosine of each row that satisfies ``is_query``.

    A row is never its own neighbour, nor is a row with the same id. Ties go to the smaller id. Repeated rows count once,
    and an id that stands with several vectors is one neighbour, with its best score; as a query it has the ``k`` nearest
    ids to any of its vectors. Vectors that are null,
    zero, of another length than most of the sample, or hold null or infinite components take no part, nor do rows
    without an id. The router is fitted on at most ``sample`` rows, drawn by hash; all rows are indexed. Parts and
    queries are dealt in blocks, so a part that draws a large share of the rows is compared in many tasks.
    """
    spark = rows.sparkSession
    usable_rows = settled(rows.filter(usable() & F.col("vec_id").isNotNull()).select("vec_id", "embedding", is_query.alias("query")).groupBy(
        "vec_id", "embedding").agg(F.max("query").alias("query")))
    drawn = usable_rows.orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").limit(sample).select("embedding").toArrow().column("embedding")
    lengths = drawn.combine_chunks().value_lengths().to_numpy() if len(drawn) else np.zeros(0, dtype=int)
    schema = "query_id long, rank int, vec_id long, score double"
    if not len(lengths):
        return spark.createDataFrame([], schema)
    length = int(np.bincount(lengths).argmax())
    same = usable_rows.filter(F.size("embedding") == length)
    parts = min(MOST_PARTS, max(1, -(-same.count() // part_rows)))
    router = fit_router(stacked(drawn.filter(pa.array(lengths == length))), parts, recall)
    indexed = settled(same.mapInArrow(_indexer(router), f"{_ddl(same)}, part int, visit array<int>"))
    held = {r["part"]: (r["rows"], r["queries"]) for r in indexed.groupBy("part").agg(
        F.count(F.lit(1)).alias("rows")).join(indexed.filter("query").select(F.explode("visit").alias("part")).groupBy("part").agg(
            F.count(F.lit(1)).alias("queries")), "part", "full").fillna(0).collect()}
    cells = spark.createDataFrame([(p, max(1, -(-n // ROW_BLOCK)), max(1, -(-q // QUERY_BLOCK))) for p, (n, q) in held.items()],
                                  "part int, row_blocks int, query_blocks int")
    # One row per part, at most MOST_PARTS of them.
    cells = F.broadcast(cells)
    stored = indexed.select("vec_id", "embedding", "part").join(cells, "part").select(
        "part", F.pmod(F.xxhash64("vec_id"), "row_blocks").cast("int").alias("b"), F.explode(F.expr("sequence(0, query_blocks - 1)")).alias("q"),
        F.lit(False).alias("query"), "vec_id", "embedding")
    asked = indexed.filter("query").select("vec_id", "embedding", F.explode("visit").alias("part")).join(cells, "part").select(
        "part", F.explode(F.expr("sequence(0, row_blocks - 1)")).alias("b"), F.pmod(F.xxhash64("vec_id"), "query_blocks").cast("int").alias("q"),
        F.lit(True).alias("query"), "vec_id", "embedding")
    keys = ["part", "b", "q"]
    dealt = stored.unionByName(asked).repartition(tasks_for(spark), *keys).sortWithinPartitions(*keys)
    near = dealt.mapInArrow(_ranker(k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def _indexer(router: Router):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            scores = router.scores(_unit(stacked(batch.column("embedding"))))
            order = np.argsort(-scores, axis=1, kind="stable")[:, : router.visits].astype(np.int32)
            visit = pa.array(list(order), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(order[:, 0]), visit], names=[*batch.schema.names, "part", "visit"])

    return index


def _ranker(k: int):
    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ["part", "b", "q"], 4096):
            starts = np.append(run_starts(table, ["part", "b", "q"]), table.num_rows)
            ids, asks = table.column("vec_id").to_numpy(), table.column("query").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                asked, stored = a + np.flatnonzero(asks[a:b]), a + np.flatnonzero(~asks[a:b])
                if len(asked) and len(stored):
                    matrix = stacked(table.column("embedding").slice(a, b - a))
                    yield _nearest(ids[asked], matrix[asked - a], ids[stored], matrix[stored - a], k)

    return rank


def _nearest(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> pa.RecordBatch:
    """The k nearest ids of each query, each with its best row. A fast product finds their rows with the near ties, whose
    cosines are then summed in one fixed order, so equal vectors tie exactly."""
    turn = np.argsort(ids, kind="stable")
    ids, rows = ids[turn], rows[turn]
    starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    rough = queries @ rows.T / (np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(rows, axis=1))
    rough[query_ids[:, None] == ids] = -np.inf
    best, last = np.maximum.reduceat(rough, starts, axis=1), min(k, len(starts)) - 1
    least = -np.partition(-best, last, axis=1)[:, last]
    q, r = np.nonzero((rough >= least[:, None] - 1e-12) & (rough > -np.inf))
    sizes = [np.sqrt(np.einsum("ij,ij->i", m, m)) for m in (queries, rows)]
    scores = np.concatenate([np.einsum("ij,ij->i", queries[a], rows[b]) / (sizes[0][a] * sizes[1][b])
                             for a, b in zip(np.array_split(q, len(q) // 65536 + 1), np.array_split(r, len(r) // 65536 + 1), strict=True)])
    turn = np.lexsort((-scores, ids[r], q))
    turn = turn[np.append(True, (np.diff(q[turn]) != 0) | (np.diff(ids[r[turn]]) != 0))[: len(turn)]]
    turn = turn[np.lexsort((ids[r[turn]], -scores[turn], q[turn]))]
    q, r, scores = q[turn], r[turn], scores[turn]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    top = place < k
    return pa.RecordBatch.from_arrays([pa.array(query_ids[q[top]]), pa.array(ids[r[top]]), pa.array(scores[top])], names=["query_id", "vec_id", "score"])
