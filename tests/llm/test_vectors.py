"""Search and near-dedup of embeddings against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hotelspark.llm import ann, caps
from tests.conftest import SF_DIR

SCHEMA = "vec_id long, embedding array<float>, label int, node string, part string, h0 string"


def rows(seed=5, count=300, dims=16):
    rng = np.random.default_rng(seed)
    vectors = rng.standard_normal((count, dims))
    vectors[100:160] = vectors[7] + 0.02 * rng.standard_normal((60, dims))
    vectors[160:180] = vectors[8]
    vectors[180:190] = 4 * np.float32(vectors[9])
    out = [(i, [float(np.float32(x)) for x in v], i % 3 if i < 100 else 1, "n", "p", "h") for i, v in enumerate(vectors)]
    out += [
        (900, None, 1, None, None, None), (901, [0.0] * dims, 1, None, None, None), (902, [1.0, None] + [0.0] * (dims - 2), 1, None, None, None),
        (903, [float("nan")] * dims, 1, None, None, None), (904, [float("inf")] + [1.0] * (dims - 1), 1, None, None, None),
        (905, out[8][1], None, None, None, None), (950, [1.0, 2.0], 1, None, None, None), (None, out[8][1], 1, None, None, None),
    ]
    return out


def usable(row):
    v = row[1]
    return row[0] is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)


def cosine(a, b):
    a, b = np.array(a, dtype=float), np.array(b, dtype=float)
    return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))


@pytest.mark.parametrize("together", [512, 7])
def test_links_and_components(spark, together):
    data = rows()
    found = caps.near_duplicates(spark.createDataFrame(data, SCHEMA), together=together).collect()
    part, links = {r[0]: r[0] for r in data}, dict.fromkeys([r[0] for r in data], 0)
    good = [r for r in data if usable(r) and r[2] is not None]
    for i, a in enumerate(good):
        for b in good[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]) and cosine(a[1], b[1]) >= 0.98:
                links[a[0]] += 1
                links[b[0]] += 1
                old, new = max(part[a[0]], part[b[0]]), min(part[a[0]], part[b[0]])
                part = {k: new if v == old else v for k, v in part.items()}
    assert len(found) == len(data)
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in found} == {
        (k, links[k], part[k], k is not None and part[k] == k) for k in part}


def test_no_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert caps.near_duplicates(none).collect() == [] and ann.search(none, F.lit(True)).collect() == []


def test_decoding_lists_all_directions_in_the_margin():
    units = np.random.default_rng(2).standard_normal((20, 9))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    row, word = caps.decode(units, 0.2)
    parts = caps.code(9)
    sums = sum((units[:, p] @ v.T).reshape(20, *[len(v) if i == j else 1 for j in range(len(parts))]) for i, (p, v) in enumerate(parts))
    sums = sums.reshape(20, -1)
    assert [(r, w) for r, w in zip(*np.nonzero(sums >= sums.max(axis=1, keepdims=True) - 0.2), strict=True)] == list(zip(row, word, strict=True))


def pairs_at(cosine_, count, dims, kind, seed=6):
    """Unit vectors and partners at a cosine whose difference lies in one component, one third, or anywhere."""
    rng = np.random.default_rng(seed)
    u, off = rng.standard_normal((count, dims)), rng.standard_normal((count, dims))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    if kind != "any":
        width = 1 if kind == "component" else dims // 3
        off *= (np.arange(dims) - rng.integers(0, dims, (count, 1))) % dims < width
    off -= (off * u).sum(axis=1, keepdims=True) * u
    return u, cosine_ * u + np.sqrt(1 - cosine_**2) * off / np.linalg.norm(off, axis=1, keepdims=True)


@pytest.mark.parametrize("dims", [2, 9, 16, 64, 100])
def test_lists_meet_whatever_the_difference(dims):
    for kind in ("component", "block", "any") if dims > 2 else ("any",):
        u, v = pairs_at(0.98, 1000, dims, kind)
        (ru, wu), (rv, wv) = (caps.meeting_directions(x, 0.98) for x in (u, v))
        assert {r for r, _ in set(zip(ru.tolist(), wu.tolist(), strict=True)) & set(zip(rv.tolist(), wv.tolist(), strict=True))} == set(range(1000))


def test_links_close_to_the_cosine(spark):
    data = []
    for kind in ("component", "block"):
        for u, v in zip(*pairs_at(0.98001, 3000, 16, kind), strict=True):
            data += [(len(data), u.tolist(), len(data)), (len(data) + 1, v.tolist(), len(data))]
    found = caps.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")).collect()
    assert {(r.vec_id, r.n_links, r.component_id) for r in found} == {(i, 1, label) for i, _, label in data}


@pytest.mark.parametrize("part_rows", [10_000, 60])
def test_search(spark, monkeypatch, part_rows):
    monkeypatch.setattr(ann, "ROW_BLOCK", 40)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 3)
    data = rows()
    found = ann.search(spark.createDataFrame(data, SCHEMA), F.col("vec_id") % 10 == 0, part_rows=part_rows, recall=1.0).collect()
    good = [r for r in data if usable(r) and len(r[1]) == 16]
    hits = total = 0
    for q in (r for r in good if r[0] % 10 == 0):
        want = sorted(((-round(cosine(q[1], r[1]), 12), r[0]) for r in good if r[0] != q[0]))[:5]
        got = sorted((r for r in found if r.query_id == q[0]), key=lambda r: r.rank)
        assert [r.rank for r in got] == [1, 2, 3, 4, 5]
        assert all(abs(r.score - cosine(q[1], next(x[1] for x in good if x[0] == r.vec_id))) < 1e-12 for r in got)
        hits += len({v for _, v in want} & {r.vec_id for r in got})
        total += 5
        if part_rows > 1000:
            assert [r.vec_id for r in got] == [v for _, v in want]
    assert hits >= 0.9 * total


@pytest.mark.parametrize("part_rows", [10_000, 60])
def test_search_among_repeated_rows(spark, part_rows):
    data = [r[:2] for r in rows() if usable(r) and len(r[1]) == 16]
    nearest = [max((r for r in data if r[0] != q), key=lambda r: cosine(data[q][1], r[1])) for q in (7, 100, 160)]
    data += nearest * 5 + [data[7]] * 4 + [(102, data[103][1]), (102, data[30][1])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    found = ann.search(df, F.col("vec_id").isin(7, 100, 160), part_rows=part_rows, recall=1.0).collect()
    for query in (7, 100, 160):
        own, best = next(v for i, v in data if i == query), {}
        for i, v in data:
            if i != query:
                best[i] = max(best.get(i, -2), round(cosine(own, v), 12))
        want = sorted(best, key=lambda i: (-best[i], i))[:5]
        got = [r.vec_id for r in sorted((r for r in found if r.query_id == query), key=lambda r: r.rank)]
        assert len(set(got)) == 5 and (part_rows < 1000 or got == want)


def test_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    found = ann.search(df, F.col("vec_id") == 0).collect()
    assert [(r.rank, r.vec_id) for r in sorted(found, key=lambda r: r.rank)] == [(1, 2), (2, 1)]


def test_parts_are_balanced():
    units = np.random.default_rng(4).standard_normal((600, 8))
    part = ann.balanced_parts(ann.neighbour_graph(units / np.linalg.norm(units, axis=1, keepdims=True), 8), 6)
    assert np.bincount(part, minlength=6).max() <= np.ceil(100 * 1.05)


def test_recall_on_the_table(spark):
    df = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    found = ann.search(df, F.col("vec_id") % 50 == 0, part_rows=60).collect()
    data = df.collect()
    matrix = np.array([r.embedding for r in data], dtype=float)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    ids = np.array([r.vec_id for r in data])
    hits = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        score = matrix @ matrix[i]
        score[i] = -2
        hits += len(set(ids[np.argsort(-score)[:5]]) & {r.vec_id for r in found if r.query_id == ids[i]})
        total += 5
    assert hits >= 0.9 * total
