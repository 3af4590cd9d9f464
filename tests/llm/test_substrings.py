from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from hotelspark.llm import substrings
from tests.llm import cases

LAST = 1 << 62


def brute(rows, size):
    least = {}
    words = [(t or "").encode().split() for _, t in rows]
    for (doc, _), own in zip(rows, words, strict=True):
        for i in range(len(own) - size + 1):
            key = tuple(own[i : i + size])
            least[key] = min(least.get(key, LAST), LAST if doc is None else doc)
    out = Counter()
    for (doc, _), own in zip(rows, words, strict=True):
        gone = [False] * len(own)
        for i in range(len(own) - size + 1):
            if least[tuple(own[i : i + size])] < (LAST if doc is None else doc):
                gone[i : i + size] = [True] * size
        kept = b" ".join(w for w, g in zip(own, gone, strict=True) if not g)
        out[doc, len(own), sum(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("chunk", [8 << 20, 3000])
def test_hard_cases(spark, monkeypatch, chunk):
    monkeypatch.setattr(substrings, "CHUNK", chunk)
    docs = cases.clashing(cases.documents(spark))
    found = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.with_repeats(docs).collect())
    assert found == brute([(r.doc_id, r.text) for r in docs.collect()], 13)


def test_short_windows_of_few_words(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.with_repeats(docs, 5, 3).collect())
    assert found == brute(rows, 5)


def test_block_must_fit():
    with pytest.raises(ValueError):
        substrings.with_repeats(None, 12, 7)


def test_empty_table(spark):
    assert substrings.with_repeats(cases.empty(spark)).collect() == []
