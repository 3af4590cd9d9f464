"""Quality, language, packing and mixing."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hotelspark.llm import language, mixing, packing, quality
from tests.conftest import SF_DIR
from tests.llm import cases


def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def test_scores_follow_the_plain_formula():
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((400, 6)), rng.integers(0, 2, 400)
    x[y == 1] = x[y == 1] * 0.5 + 1
    means = [x[y == k].mean(axis=0) for k in (0, 1)]
    spreads = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    counts = [(y == k).sum() for k in (0, 1)]
    both = sum(n * s for n, s in zip(counts, spreads, strict=True)) / 400
    scale = np.sqrt(np.diag(both))
    logs, factors, offsets = [], [], []
    for k in (0, 1):
        unit = (0.4 * spreads[k] + 0.6 * both) / np.outer(scale, scale)
        cov = (0.98 * unit + 0.02 * np.trace(unit) / 6 * np.eye(6)) * np.outer(scale, scale)
        off = x - means[k]
        logs.append(np.log(counts[k] / 400) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off))
        lower = np.linalg.cholesky(cov / np.outer(scale, scale))
        factors.append(np.linalg.inv(lower) / scale)
        offsets.append(np.log(counts[k] / 400) - np.log(np.diag(lower)).sum())
    model = quality.Discriminant(tuple(means), tuple(factors), tuple(offsets))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_fit_equals_the_plain_moments(spark):
    rng = np.random.default_rng(2)
    x, y = rng.random((300, len(quality.FEATURES))), rng.integers(0, 2, 300)
    df = spark.createDataFrame([(int(k), [float(v) for v in row]) for k, row in zip(y, x, strict=True)], "label int, features array<double>")
    model = quality.fit(df)
    for k in (0, 1):
        assert np.allclose(model.means[k], x[y == k].mean(axis=0))


def test_quality_is_learned(spark):
    docs, labels = documents(spark), spark.read.parquet(f"{SF_DIR}/labels.parquet")
    found = quality.score_documents(docs, quality.learn(docs, labels)).join(labels, "doc_id").select("quality", "predicted").collect()
    assert sum(r.quality == r.predicted for r in found) >= 0.95 * len(found)


def test_quality_of_hard_cases(spark):
    docs = cases.clashing(cases.documents(spark))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0), (9999, 1, None)], cases.LABELS)
    scored = quality.score_documents(docs, quality.learn(docs, labels)).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in scored)
    assert len({r.score for r in scored if not (r.text or "").strip()}) >= 1
    nothing = quality.learn(docs, spark.createDataFrame([], cases.LABELS))
    assert {r.score for r in quality.score_documents(docs, nothing).collect()} == {0.5}
    assert quality.accepted(docs, nothing).columns == docs.columns
    assert quality.score_documents(cases.empty(spark), nothing).collect() == []
    only = quality.learn(docs, spark.createDataFrame([(i, 1, 0) for i in range(40)], cases.LABELS))
    assert {r.score for r in quality.score_documents(docs, only).collect()} == {1.0}


def test_language_of_held_out_documents(spark):
    docs = documents(spark)
    found = language.identify(docs, language.learn(docs)).filter(quality.held_out(3, 1)).collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found)


def test_language_of_hard_cases(spark):
    docs = cases.clashing(cases.documents(spark))
    learned = language.learn(docs)
    assert set(learned) == {"en", "de"}
    for r in language.identify(docs, learned).collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred in learned) if letters else (r.lang_pred == "und" and r.score == 0)
        assert 0 <= r.score <= 1
    assert {r.lang_pred for r in language.identify(docs, {}).collect()} == {"und"}
    assert language.learn(cases.empty(spark)) == {}


def test_bundles_do_not_depend_on_the_kept_table(monkeypatch):
    grams, counts = language.gram_counts("Über den Wolken, muss die Freiheit wohl grenzenlos sein " * 3)
    whole = language.Space().bundle(grams, counts)
    monkeypatch.setattr(language, "KEPT_GRAMS", 5)
    small = language.Space()
    pieces = sum(small.bundle(grams[i : i + 4], counts[i : i + 4]) for i in range(0, len(grams), 4))
    assert np.allclose(whole, pieces, rtol=1e-4, atol=1e-2)
    letters = {g: c for g, c in zip(grams.tolist(), counts.tolist(), strict=True)}
    assert sum(letters.values()) == len(" über den wolken muss die freiheit wohl grenzenlos sein" * 3 + " ") - 2


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


@pytest.mark.parametrize("text", ["", " ", "a  b", " a", "a ", "a \nb c", "x  y z", "I'll  go", "a\x1c b", "<|endoftext|> a b", "é ê  ü\n\n d", " a  b"])
def test_ids_of_odd_texts(text):
    assert np.frombuffer(packing.tokens().ids(text), dtype="<u4").tolist() == tokenizer().encode(text, add_special_tokens=False).ids


MARKED = ["see <|endoftext|> a b", "<|endoftext|>", "a<|endoftext|><|endoftext|>  b ", "x  <|endoftext|>\n y z <|endoftext|", "<|endoftext|> a  b"]


def test_added_tokens_have_their_ids(spark):
    plain = tokenizer()
    plain.encode_special_tokens = False
    found = packing.pieces(spark.createDataFrame(list(enumerate(MARKED)), "doc_id long, text string")).collect()
    want = [np.array([*plain.encode(t, add_special_tokens=False).ids, 0], dtype="<u4") for t in MARKED]
    assert want[0].tolist() == [3826, 220, 50256, 257, 275, 0]
    assert {(r.doc_id, r.length, r.ids_crc32) for r in found} == {(i, len(ids), zlib.crc32(ids.tobytes())) for i, ids in enumerate(want)}


def test_packing_of_hard_cases(spark):
    docs = cases.clashing(cases.documents(spark))
    encode = tokenizer()
    rows = packing.pack_documents(docs, group=50).collect()
    sequences, documents_ = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        documents_[r.doc_id, r.k1].append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    want = Counter()
    for r in docs.collect():
        ids = np.array([*encode.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        first = len(ids) % 2048 or 2048
        edges = [0, *range(first, len(ids) + 1, 2048)]
        for n, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            want[r.doc_id, n, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert packing.pack_documents(cases.empty(spark)).collect() == []


def test_sum_of_squares_by_its_definition():
    rng = np.random.default_rng(3)
    sizes = sorted((int(x) for x in rng.integers(1, 41, 200)), reverse=True)
    bins, places = packing.sum_of_squares(sizes, 40, closing=0)
    fill, at = [], []
    for s in sizes:
        counts = Counter(40 - f for f in fill if f < 40)
        def squares(gap):
            after = counts.copy()
            if gap < 40:
                after[gap] -= 1
            if gap > s:
                after[gap - s] += 1
            return sum(n * n for n in after.values())
        gaps = sorted({g for g in counts if g >= s and counts[g]} | {40})
        best = min(gaps, key=lambda g: (squares(g), g))
        which = next((i for i in reversed(range(len(fill))) if 40 - fill[i] == best and best < 40), len(fill))
        at.append(best)
        if which == len(fill):
            fill.append(0)
        fill[which] += s
    assert [40 - p for p in places] == at
    assert max(bins) + 1 == len(fill)


def check_mix(docs, rows):
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len((r.text or "").encode().split())
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight, wanted, full = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()), set()
    while True:
        rest, shares = wanted - sum(2 * sizes[s] for s in full), sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and rest * weight[s] / shares > 2 * sizes[s]}
        if not more:
            break
        full |= more
    taken = Counter()
    for r in rows:
        target = 2 * sizes[r.source] if r.source in full else rest * weight[r.source] / shares
        assert abs(r.target - target) < 1e-6 and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        sizes_target = target
        taken[r.source, "target"] = sizes_target
    assert all(abs(taken[s] - taken[s, "target"]) <= 1 for s in names)


def test_mixing_of_hard_cases(spark):
    docs = cases.clashing(cases.documents(spark))
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == docs.count()
    check_mix(docs, rows)
    key = lambda r: (r.doc_id or -1, r.k1, r.taken)
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert mixing.mix_sources(cases.empty(spark)).collect() == []


def test_sources_without_words(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, " ", None)], "doc_id long, text string, source string")
    assert {(r.size, r.taken, r.target) for r in mixing.mix_sources(docs).collect()} == {(0, 0, 0.0)}


def test_mixed_documents_hold_the_words_taken(spark):
    docs = cases.clashing(cases.documents(spark)).dropDuplicates(["doc_id", "text"])
    mix = mixing.mix_sources(docs)
    out = mixing.mixed_documents(docs, mix)
    assert out.columns == docs.columns
    words = out.select("source", mixing.word_count().alias("n")).groupBy("source").agg(F.sum("n").alias("n")).collect()
    want = mix.groupBy("source").agg(F.sum("taken").alias("n")).filter("n > 0").collect()
    assert {tuple(r) for r in words} == {tuple(r) for r in want}


@pytest.mark.parametrize("partitions", [1, 5])
def test_prefix_sums(spark, partitions):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("a"), (F.col("id") % 13).alias("n")).repartition(partitions)
    total = 0
    for r in sorted(mixing.prefix_sums(df, ["a"], {"n": "before"}).collect()):
        assert r.before == total
        total += r.n
