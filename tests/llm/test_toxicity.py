"""Toxicity: the label model's EM step against plain counting, hard cases, and held-out accuracy on the given table."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hotelspark.llm import quality, toxicity
from tests.llm import cases


def test_em_step_matches_plain_counting(spark):
    rng = np.random.default_rng(4)
    votes = rng.choice([-1, 0, 1], size=(300, 5), p=[0.6, 0.2, 0.2])
    patterns = {}
    for v in votes:
        patterns[tuple(v)] = patterns.get(tuple(v), 0) + 1
    frame = spark.createDataFrame([(list(map(int, k)), n) for k, n in patterns.items()], "v array<int>, n long")
    model = toxicity.LabelModel(0.3, (((0.6, 0.3, 0.1),) * 5, ((0.5, 0.1, 0.4),) * 5), (1.0, 0.5, 1.0, 1.0, 0.8))
    prior, counts = toxicity._tally(frame, model.posterior(F.col("v")), 5)

    def post(v):
        odds = np.log(0.3 / 0.7) + sum(w * np.log(model.theta[1][j][x + 1] / model.theta[0][j][x + 1])
                                       for j, (x, w) in enumerate(zip(v, model.weights, strict=True)))
        return 1 / (1 + np.exp(-odds))

    q = np.array([post(v) for v in votes])
    assert prior == pytest.approx(q.mean())
    for j in range(5):
        for x in (-1, 0, 1):
            assert counts[1][j][x + 1] == pytest.approx(toxicity.SMOOTH + q[votes[:, j] == x].sum())
            assert counts[0][j][x + 1] == pytest.approx(toxicity.SMOOTH + (1 - q[votes[:, j] == x]).sum())


def test_votes_of_hard_texts(spark):
    rows = spark.createDataFrame([(None,), ("",), ("You are such an IDIOT!!!",), ("calm text",), ("f*** you",)], "text string")
    got = [r.v for r in rows.select(toxicity.votes(F.col("text"), ["idiot", "stupi*"]).alias("v")).collect()]
    #          idiot stupi* shout exclaim masked you clean
    assert got == [[-1, -1, -1, -1, -1, -1, 0], [-1, -1, -1, -1, -1, -1, 0], [1, -1, 1, 1, -1, 1, -1],
                   [-1, -1, -1, -1, -1, -1, 0], [-1, -1, -1, -1, 1, -1, 0]]


def test_given_table_scores_held_out_rows_and_hard_cases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    learned = toxicity.learn(docs, labels)
    scored = toxicity.score_documents(docs, learned).withColumn("held_out", quality.held_out(5, 0)).join(labels, "doc_id")
    held = scored.filter("held_out AND toxic IS NOT NULL").toPandas()
    assert (held.predicted == held.toxic).mean() >= 0.9
    assert held[held.toxic == 1].score.mean() > held[held.toxic == 0].score.mean() + 0.3
    hard = cases.clashing(cases.documents(spark))
    out = toxicity.score_documents(hard, learned).toPandas()
    assert len(out) == hard.count() and out.score.between(0, 1).all()
    assert set(out.predicted) <= {0, 1}
    assert toxicity.score_documents(cases.empty(spark), learned).count() == 0
    # The query's path: one featured table for learning and scores, the same rows and scores as the two steps.
    both = toxicity.learn_and_score(docs, labels).toPandas().sort_values(["doc_id", "score"]).reset_index(drop=True)
    apart = toxicity.score_documents(docs, learned).toPandas().sort_values(["doc_id", "score"]).reset_index(drop=True)
    assert len(both) == docs.count() and (both.doc_id == apart.doc_id).all()
    assert (both.score - apart.score).abs().max() < 1e-6 and (both.predicted == apart.predicted).all()


def plain_lexicon(docs, marks):
    """The lexicon by plain counting; ``docs`` (doc_id, text) are all in the training fold."""
    count = {}
    for doc_id, text in docs:
        if doc_id in marks:
            found = set("".join(c if c.isalpha() else " " for c in (text or "").lower()).split())
            for w in found | {w[:toxicity.STEM] + "*" for w in found if len(w) > toxicity.STEM}:
                pos, n = count.get(w, (0, 0))
                count[w] = (pos + marks[doc_id], n + 1)

    def bound(pos, n, z=1.96):
        p = pos / n
        return (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)
    good = [(-bound(*c), -c[0], w) for w, c in count.items() if c[0] >= toxicity.MIN_SUPPORT and bound(*c) >= toxicity.PRECISION]
    return [w for _, _, w in sorted(good)[:toxicity.LEXICON]]


@pytest.mark.parametrize("listed, broadcast", [(2000, 200_000), (0, 0)])
def test_lexicon_equals_plain_counting(spark, monkeypatch, listed, broadcast):
    monkeypatch.setattr(toxicity, "LISTED_WORDS", listed)
    monkeypatch.setattr(toxicity, "BROADCAST_WORDS", broadcast)
    rng = np.random.default_rng(8)
    common, bad = [f"plain{c}" for c in "abcdefghijklmnop"], [f"bad{c}" for c in "abcdefgh"]
    docs, marks = [], {}
    for i in range(900):
        toxic = int(rng.random() < 0.3)
        own = [w for k, w in enumerate(bad) if rng.random() < (0.5 if toxic else 0.03 * k)]
        docs.append((i, None if i % 50 == 0 else " ".join([*rng.choice(common, 6), *own])))
        if i % 3:
            marks[i] = toxic
    docs += docs[:40] + [(None, "bada badb")] * 9
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(k, v) for k, v in marks.items()] + [(0, None), (None, 1)], "doc_id long, toxic int")
    held = {r.doc_id for r in frame.filter(quality.held_out(5, 0)).select("doc_id").collect()}
    want = plain_lexicon([d for d in docs if d[0] not in held], marks)
    assert len(want) > 4 and toxicity.lexicon(frame, labels) == want


def test_featured_rows_are_kept_as_packed_files(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    table = toxicity._kept(toxicity.featured(docs, ["idiot"], toxicity._hashing()))
    assert table.inputFiles() and all(f.endswith(".zstd.parquet") for f in table.inputFiles())
    assert table.count() == docs.count() and table.columns == ["doc_id", "_v", "features", "_pick"]


def test_kept_hashed_words_are_stored_as_differences(spark):
    import pyarrow.dataset as ds

    docs = spark.createDataFrame([(i, f"you {'xyz' * i} idiot word{i}") for i in range(60)], "doc_id long, text string")
    made = toxicity.featured(docs, ["idiot"], toxicity._hashing())
    table = toxicity._kept(made)
    kinds = {}
    for file in table.inputFiles():
        group = next(ds.dataset(file.removeprefix("file://")).get_fragments()).metadata.row_group(0)
        kinds |= {c.path_in_schema: set(c.encodings) for c in map(group.column, range(group.num_columns))}
    assert "DELTA_BINARY_PACKED" in kinds["features.indices.list.element"]
    assert sorted(table.collect()) == sorted(made.collect())


def plain_votes(spark, text, lexicon_):
    """The votes by Java's own search over the whole text and its whole list of words."""
    pattern = spark._jvm.java.util.regex.Pattern
    found = lambda p, s: pattern.compile(p).matcher(s).find()
    raw, lower = text or "", (text or "").lower()
    run = set("".join(c if c.isalpha() else " " for c in lower).split())
    run |= {w[:toxicity.STEM] + "*" for w in run if len(w) > toxicity.STEM}
    ends = "|".join(w[:-1] + r"\p{L}*" if w.endswith("*") else w for w in lexicon_) or "\0"
    you = r"(^|[^\p{L}])(you|you're|ur)([^\p{L}]+\p{L}+){0,3}[^\p{L}]+(" + ends + r")([^\p{L}]|$)"
    return [*(1 if w in run else -1 for w in lexicon_),
            *(v if found(p, raw if "Lu" in p else lower) else -1 for _, p, v in toxicity.PATTERNS),
            1 if found(you, lower) else -1, -1 if run & set(lexicon_) else 0]


def test_watched_terms_give_the_votes_of_the_whole_text(spark):
    texts = ["you idiot", "you are idiots", "ur such a real stupid", "you're scum", "you a b c d idiot", "idiot you", "yours idiot",
             "my idiotic friend", "YOU UTTER IDIOTS", "ABCD", "ABC D", "abcDEFGh", "\u00c4\u00d6\u00dc\u00c4 you", "you\nidiot\n", "you idiot\u00e9", "you \0 x",
             "your scummy", "the scum, you", "you, 12 scum!!", "ur", "", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for lexicon_ in (["idiot*", "scum", "stupi*"], ["idiot", "you"], ["scum"], []):
        got = [r._v for r in toxicity._voted(frame, lexicon_).orderBy("doc_id").select("_v").collect()]
        assert got == [plain_votes(spark, t, lexicon_) for t in texts], lexicon_
    seen = toxicity._voted(frame, ["idiot*"]).select(toxicity.watched(F.col("_t"), ["idiot*"]).alias("f"), "doc_id").orderBy("doc_id")
    assert [sorted(r.f) for r in seen.limit(3).collect()] == [["idiot", "you"], ["idiot*", "you"], ["ur"]]


def test_few_labels_come_to_the_texts(spark):
    docs = spark.createDataFrame([(i, "some words") for i in range(20)], "doc_id long, text string")
    marks = docs.selectExpr("doc_id", "int(doc_id % 2) AS toxic").filter("doc_id < 9")
    plan = lambda: toxicity._labelled(docs, marks, True)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan() and "hashpartitioning" not in plan()
    assert toxicity._labelled(docs, marks, True).count() == 9 and toxicity._labelled(docs, marks, False) is docs
