from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from hotelspark.llm import suffixes
from tests.llm import cases


def brute(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        starts = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_classes_are_the_repeated_windows(seed):
    rng = random.Random(seed)
    width, strings = rng.choice([1, 2, 3, 5]), [[rng.choice([1, 2, 3]) for _ in range(rng.randint(1, 14))] for _ in range(rng.randint(1, 12))]
    weights = [rng.choice([1, 1, 2]) for _ in strings]
    count = Counter()
    for s, w in zip(strings, weights, strict=True):
        for i in range(len(s) - width + 1):
            count[tuple(s[i : i + width])] += w
    flags = suffixes.suffix_classes([np.array(s) for s in strings], np.array(weights), width)
    assert [f.tolist() for f in flags] == [[count[tuple(s[i : i + width])] > 1 for i in range(len(s) - width + 1)] for s in strings]


@pytest.mark.parametrize("around", [256, 1])
def test_hard_cases(spark, monkeypatch, around):
    monkeypatch.setattr(suffixes, "AROUND", around)
    docs = cases.documents(spark)
    rows = suffixes.measure_repeats(cases.clashing(docs)).collect()
    texts = [(r.text or "").encode() for r in docs.collect()]
    want = Counter(zip([r.doc_id for r in docs.collect()], brute(texts, 400), strict=True))
    assert Counter((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in rows) == want


def test_short_windows_in_random_text(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 90))) for _ in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in suffixes.measure_repeats(docs, 12, (8, 4, 2, 1)).collect()}
    for i, want in enumerate(brute([t.encode() for t in texts], 12)):
        assert (rows[i].n_bytes, rows[i].n_removed, rows[i].n_spans, rows[i].kept_sha256) == want


def test_stripped_text_is_whole_characters(spark):
    docs = spark.createDataFrame([(1, "é" + "ab" * 300 + "ß"), (2, "è" + "ab" * 300 + "ü"), (3, None)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in suffixes.strip_repeats(cases.clashing(docs)).collect()}
    assert out == {1: "éß", 2: "èü", 3: None}


def test_empty_table(spark):
    assert suffixes.measure_repeats(cases.empty(spark)).collect() == []
    assert suffixes.strip_repeats(cases.empty(spark)).columns == cases.empty(spark).columns


def test_passages_just_under_and_over_the_length(spark):
    """A passage shared by two documents goes when it has 400 bytes or more, and stays when it has 399."""
    from hotelspark.llm import suffixes as S

    def filler(seed: int, n: int) -> str:
        rng = random.Random(seed)
        return "".join(rng.choice("abcdefghij klmnopqrst") for _ in range(n))

    under, over = filler(1, 399), filler(2, 400)
    rows = [(1, filler(3, 300) + under + filler(4, 300)), (2, filler(5, 200) + under),
            (3, filler(6, 300) + over + filler(7, 300)), (4, over + filler(8, 250))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in S.measure_repeats(docs).collect()}
    assert got[1] == got[2] == 0
    assert got[3] >= 400 and got[4] >= 400
