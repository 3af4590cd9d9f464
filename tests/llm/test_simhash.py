from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from hotelspark.llm import simhash
from tests.llm import cases


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components(fps, most=3):
    part = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= most and part[i] != part[j]:
                old, new = max(part[i], part[j]), min(part[i], part[j])
                part = [new if p == old else p for p in part]
    return part


def test_hard_cases(spark):
    docs = cases.clashing(cases.documents(spark))
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    fps = [plain_fingerprint(r.text) for r in rows]
    part = components(fps)
    want = sorted((r.doc_id if r.doc_id is not None else -1, fp, rows[p].doc_id) for r, fp, p in zip(rows, fps, part, strict=True))
    found = simhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.fp % (1 << 64), r.component_id) for r in found) == want


def test_one_document_of_each_group(spark):
    docs = cases.clashing(cases.documents(spark))
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    groups = len(set(components([plain_fingerprint(r.text) for r in docs.collect()])))
    assert kept.count() == groups


@pytest.mark.parametrize("longest", [2048, 8, 2])
def test_links_of_a_dense_ball(spark, longest):
    """Many fingerprints around few centres, and chains that only hold together link by link."""
    rng = random.Random(longest)
    fps = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        fps |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(60)}
        for _ in range(15):
            centre ^= sum(1 << b for b in rng.sample(range(64), 3))
            fps.add(centre)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    at = {int(np.uint64(f).view(np.int64)): i for i, f in enumerate(fps)}
    part = list(range(len(fps)))
    found = simhash.links(df, 3, longest).collect()
    for r in found:
        a, b = at[r.u], at[r.v]
        assert bin(fps[a] ^ fps[b]).count("1") <= 3
        old, new = max(part[a], part[b]), min(part[a], part[b])
        part = [new if p == old else p for p in part]
    assert len(set(zip(part, components(fps), strict=True))) == len(set(part)) == len(set(components(fps)))


def test_empty_table(spark):
    assert simhash.near_duplicates(cases.empty(spark)).collect() == []
