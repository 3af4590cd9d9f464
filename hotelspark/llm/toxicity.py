"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier.

1. Voters. Lexicon voters are words and word stems (the first ``STEM`` letters of longer words, for insults that
   are glued to endings) learned from the labelled rows of the training fold: among those standing in at
   least ``MIN_SUPPORT`` toxic documents and whose lower confidence bound (Wilson, 95 %) of the toxic share is at
   least ``PRECISION``, the ``LEXICON`` ones with the highest bound. Each votes 1 when its word stands in a text and abstains otherwise. Pattern voters are fixed
   (below); one of them votes 0 for texts with no lexicon word.
2. Label model. Each voter has, per class, a distribution over (abstain, 0, 1); with a class prior these give the
   votes' likelihood. The parameters start from the training fold's labels and are then fitted by EM to the votes
   of all documents, labels unseen. Correlations between voters are estimated per class from the posteriors; a voter's
   log-likelihood counts with weight 1 / (1 + sum of its positive correlations), so a clique of voters that fire
   together counts about once; EM runs again with these weights. Every EM step is one aggregation over the distinct
   vote vectors and their counts, which Spark combines before the shuffle.
3. Classifier. A logistic regression over hashed words of the whole text and the votes learns the posterior labels
   (each row twice, label 1 weighted by the posterior, label 0 by its complement) from at most ``TRAIN_ROWS``
   documents chosen by hash; its probability is the score of every document.

Cases: a null text is the empty text; an empty text gets the votes of a text without words and a score like any other;
repeated rows get equal scores; no label, lang, source or doc_id is an input of a score; extra columns are ignored; an
empty table gives no rows, and a training fold without both classes raises.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hotelspark.llm.common import settled, shared_folder
from hotelspark.llm.quality import held_out

LEXICON = 32
STEM = 5
MIN_SUPPORT = 5
#: Labelled documents' ids and lexicon candidates are broadcast up to this many, else joined by a shuffle.
BROADCAST_WORDS = 200_000
#: Parts of the labelled documents, one of which rules out most candidates, and the number of words left up to which
#: texts are cut down to them by a list, not by a join. Neither changes a result.
SLICES = 4
LISTED_WORDS = 2000
#: A lexicon voter must be right at least this often when it votes, by the lower bound of its share.
PRECISION = 0.5
#: Bound on the rows the linear classifier is fitted on (chosen by a hash of the row); all rows are scored.
TRAIN_ROWS = 200_000
FEATURES = 1 << 16
#: Distinct vote vectors per task of the label model's steps.
TASK_ROWS = 100_000
#: Rows per task of the classifier. Each task keeps its rows in memory for the iterations, and a few hundred MB at once
#: do not find room there and go to disk; each further task adds its gradient to every iteration's shuffle.
FIT_ROWS = 35_000
ROUNDS = 20
#: EM stops early once no probability of the label model moves by more than this.
SETTLED = 1e-5
SMOOTH = 1.0
ACCEPT = 0.5

# Fixed pattern voters: (name, regular expression over the lower-cased text, vote when it matches).
PATTERNS = (
    ("shouting", r"(^|[^\p{L}])\p{Lu}{4,}([^\p{L}]|$)", 1),
    ("exclaims", r"!{2,}", 1),
    ("masked", r"[*#@$%&]{3,}", 1),
)

#: Stands in every text that shouts, and is found sooner.
CAPITALS = r"\p{Lu}{4}"
#: Words that start an address; "you're" is the words "you" and "re".
ADDRESSED = ("you", "ur")

_LETTERS = r"[^\p{L}]+"


def words(text: Column) -> Column:
    """The distinct lower-cased letter runs of a text; null is the empty text."""
    return _distinct_words(F.lower(F.coalesce(text, F.lit(""))))


def _distinct_words(lower: Column) -> Column:
    return F.array_except(F.split(lower, _LETTERS), F.array(F.lit("")))


def terms(found: Column) -> Column:
    """Words and the stems of longer words (``STEM`` letters and ``*``) of a words array."""
    stems = F.transform(F.filter(found, lambda w: F.length(w) > STEM), lambda w: F.concat(F.substring(w, 1, STEM), F.lit("*")))
    return F.array_union(found, stems)


def _few(rows: DataFrame) -> DataFrame:
    """``rows`` (settled) marked for a broadcast when there are at most BROADCAST_WORDS, else as they are."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_WORDS else rows


def _labelled(rows: DataFrame, marks: DataFrame, now: bool) -> DataFrame:
    """``rows`` with their labels if ``now``, else as they are; at most BROADCAST_WORDS labels are broadcast."""
    return rows.join(_few(marks), "doc_id") if now else rows


def lexicon(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> list[str]:
    """Words of the training fold's toxic documents with the highest lower bound of their toxic share."""
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"))
    marks = settled(marks)
    near = marks.count() <= BROADCAST_WORDS
    learned = docs.filter(F.col("doc_id").isNotNull() & ~held_out(folds, held)).select("doc_id", "text")
    # Words stand in a column of their own: terms() names them twice, and Spark would split the text for each.
    found = lambda rows: rows.select(words(F.col("text")).alias("_w"), "toxic").select(
        F.explode(terms(F.col("_w"))).alias("w"), "toxic")
    # Texts are many times larger than the counts, so few of them are shuffled to their labels.
    # 1. Only words of at least MIN_SUPPORT toxic documents can be voters. The toxic documents are few; their ids are
    #    broadcast up to BROADCAST_WORDS, and so are those of the clean ones below.
    candidates = settled(found(learned.join(_few(marks.filter(F.col("toxic") > 0)), "doc_id")).groupBy("w").agg(
        F.sum("toxic").alias("most"), F.count(F.lit(1)).alias("hits"), F.count_if(F.col("toxic") == 1).alias("pos")).filter(
        F.col("pos") >= MIN_SUPPORT))
    # 2. One of SLICES parts of the other labelled documents rules out most of these words: a word whose share stays below
    #    PRECISION even if it stood in none of the other parts cannot reach that share over all of them.
    clean = learned.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)) == 0).join(
        _few(marks.filter(F.col("toxic") <= 0)), "doc_id")
    seen = found(clean).join(_few(candidates.select("w")), "w", "left_semi").groupBy("w").agg(F.count(F.lit(1)).alias("seen"))
    left = settled(candidates.join(seen, "w", "left").filter(
        F.col("most") / (F.col("hits") + F.coalesce("seen", F.lit(0))) >= PRECISION).select("w"))
    # 3. The words left are counted in all labelled documents: few labels are broadcast, so that only labelled texts are
    #    split; else each text is cut down to these words before it meets its label.
    split = _labelled(learned, marks, near).withColumn("_w", words(F.col("text"))).drop("text")
    marked = lambda rows: _labelled(rows, marks, not near)
    if left.count() <= LISTED_WORDS:
        held_words = F.array(*[F.lit(r.w) for r in left.collect()]).cast("array<string>")
        rows = split.withColumn("ws", F.array_intersect(terms(F.col("_w")), held_words)).drop("_w").filter(F.size("ws") > 0)
        rows = marked(rows).select(F.explode("ws").alias("w"), "toxic")
    else:
        rows = marked(split.withColumn("w", F.explode(terms(F.col("_w")))).drop("_w").join(_few(left), "w", "left_semi"))
    counts = rows.groupBy("w").agg(F.sum("toxic").alias("pos"), F.count(F.lit(1)).alias("n"))
    z = 1.96
    p = F.col("pos") / F.col("n")
    bound = (p + z * z / (2 * F.col("n")) - z * F.sqrt(p * (1 - p) / F.col("n") + z * z / (4 * F.col("n") ** 2))) / (
        1 + z * z / F.col("n"))
    top = counts.filter((F.col("pos") >= MIN_SUPPORT) & (bound >= PRECISION)).orderBy(bound.desc(), F.col("pos").desc(), "w").limit(LEXICON)
    return [r.w for r in top.collect()]


def _opened(lexicon_: list[str]) -> list[str]:
    """The terms of which a text has one wherever a word matches a lexicon entry as a whole: the entries, and the
    stems' own letters, since a word of just these letters has no stem."""
    return sorted({*lexicon_, *(w[:-1] for w in lexicon_ if w.endswith("*"))})


def watched(found: Column, lexicon_: list[str]) -> Column:
    """Those of a text's terms that its votes depend on; :func:`votes` gives the same for them as for all terms."""
    return F.array_intersect(found, F.array(*[F.lit(w) for w in {*_opened(lexicon_), *ADDRESSED}]))


def votes(text: Column, lexicon_: list[str], found: Column | None = None, lower: Column | None = None) -> Column:
    """Array of votes (-1 abstains, 0 clean, 1 toxic): one per lexicon word, per pattern, and the clean voter.
    ``found`` (the text's terms, or the watched ones) and ``lower`` (its lower case) may be given as columns computed once."""
    found = terms(words(text)) if found is None else found
    raw = F.coalesce(text, F.lit(""))
    lower = F.lower(raw) if lower is None else lower
    has = lambda some: F.arrays_overlap(found, F.array(*[F.lit(w) for w in some]))
    out = [F.when(F.array_contains(found, w), 1).otherwise(-1) for w in lexicon_]
    for _, pattern, vote in PATTERNS:
        hit = raw.rlike(CAPITALS) & raw.rlike(pattern) if "Lu" in pattern else lower.rlike(pattern)
        out.append(F.when(hit, vote).otherwise(-1))
    alternatives = [w[:-1] + r"\p{L}*" if w.endswith("*") else w for w in lexicon_] or ["\u0000"]
    you = lower.rlike(r"(^|[^\p{L}])(you|you're|ur)([^\p{L}]+\p{L}+){0,3}[^\p{L}]+(" + "|".join(alternatives) + r")([^\p{L}]|$)")
    # A match holds whole words of both kinds, so the search, by far the dearest voter, is left out for other texts.
    you = has(ADDRESSED) & has(_opened(lexicon_)) & you if lexicon_ else you
    out.append(F.when(you, 1).otherwise(-1))
    out.append(F.when(~has(lexicon_) if lexicon_ else F.lit(True), 0).otherwise(-1))
    return F.array(*out)


@dataclass(frozen=True)
class LabelModel:
    prior: float
    #: theta[y][j] = (P(abstain), P(0), P(1)) of voter j given class y.
    theta: tuple[tuple[tuple[float, float, float], ...], tuple[tuple[float, float, float], ...]]
    weights: tuple[float, ...]

    def log_odds(self, v: Column) -> Column:
        """log P(y=1, votes) - log P(y=0, votes) of a votes array, as a column."""
        terms = [F.lit(math.log(self.prior / (1 - self.prior)))]
        for j, w in enumerate(self.weights):
            ratio = [math.log(self.theta[1][j][k] / self.theta[0][j][k]) * w for k in range(3)]
            terms.append(F.when(v[j] == -1, ratio[0]).when(v[j] == 0, ratio[1]).otherwise(ratio[2]))
        return sum(terms[1:], terms[0])

    def posterior(self, v: Column) -> Column:
        return 1 / (1 + F.exp(-self.log_odds(v)))


def _tally(patterns: DataFrame, q: Column, m: int) -> tuple[float, list[list[list[float]]]]:
    """Posterior-weighted counts of every voter's votes per class over the vote vectors and their counts."""
    rows = patterns.select("n", "v", q.alias("q")).select(
        "n", "q", F.posexplode("v").alias("j", "vote")).groupBy("j", "vote").agg(
        F.sum(F.col("n") * F.col("q")).alias("one"), F.sum(F.col("n") * (1 - F.col("q"))).alias("zero")).collect()
    counts = [[[SMOOTH] * 3 for _ in range(m)] for _ in range(2)]
    one = every = 0.0
    for r in rows:
        counts[1][r.j][r.vote + 1] += r.one
        counts[0][r.j][r.vote + 1] += r.zero
        if r.j == 0:
            # Every row votes once per voter, so the first voter's counts are all rows.
            one, every = one + r.one, every + r.one + r.zero
    return one / max(every, 1e-12), counts


def _moved(a: LabelModel, b: LabelModel) -> float:
    steps = [abs(a.prior - b.prior)]
    for y in (0, 1):
        steps += [abs(x - z) for u, w in zip(a.theta[y], b.theta[y], strict=True) for x, z in zip(u, w, strict=True)]
    return max(steps)


def _model(prior: float, counts, weights) -> LabelModel:
    theta = tuple(tuple(tuple(c / sum(voter) for c in voter) for voter in counts[y]) for y in (0, 1))
    return LabelModel(min(max(prior, 1e-6), 1 - 1e-6), theta, tuple(weights))


def _correlations(patterns: DataFrame, model: LabelModel, m: int) -> list[float]:
    """Per voter, the sum over other voters of the positive class-conditional correlation of firing (not abstaining),
    averaged over both classes with the posterior as class weight."""
    q = model.posterior(F.col("v"))
    fired = F.filter(F.transform("v", lambda x, i: F.when(x != -1, i)), lambda i: i.isNotNull())
    base = patterns.select("n", q.alias("q"), fired.alias("f"))
    single = base.select("n", "q", F.explode("f").alias("j")).groupBy("j").agg(
        F.sum(F.col("n") * F.col("q")).alias("one"), F.sum(F.col("n") * (1 - F.col("q"))).alias("zero")).collect()
    pair = base.select("n", "q", F.explode("f").alias("j"), "f").select("n", "q", "j", F.explode("f").alias("k")).filter(
        "j < k").groupBy("j", "k").agg(F.sum(F.col("n") * F.col("q")).alias("one"),
                                      F.sum(F.col("n") * (1 - F.col("q"))).alias("zero")).collect()
    tot = base.agg(F.sum(F.col("n") * F.col("q")).alias("one"), F.sum(F.col("n") * (1 - F.col("q"))).alias("zero")).first()
    mass = {"one": max(tot.one or 0.0, 1e-9), "zero": max(tot.zero or 0.0, 1e-9)}
    rate = {c: [0.0] * m for c in mass}
    for r in single:
        for c in mass:
            rate[c][r.j] = r[c] / mass[c]
    extra = [0.0] * m
    for r in pair:
        for c in mass:
            a, b, both = rate[c][r.j], rate[c][r.k], r[c] / mass[c]
            spread = math.sqrt(a * (1 - a) * b * (1 - b))
            rho = (both - a * b) / spread if spread > 0 else 0.0
            share = mass[c] / (mass["one"] + mass["zero"])
            extra[r.j] += max(rho, 0.0) * share
            extra[r.k] += max(rho, 0.0) * share
    return [1 / (1 + e) for e in extra]


def learn_label_model(docs: DataFrame, labels: DataFrame, lexicon_: list[str], folds: int = 5, held: int = 0) -> LabelModel:
    # Votes are the costly part: computed once per row into the shared folder, then only grouped and joined.
    voted = settled(_voted(docs, lexicon_).select("doc_id", F.col("_v").alias("v")))
    return _label_model(voted, labels, len(lexicon_) + len(PATTERNS) + 2, folds, held)


def _label_model(voted: DataFrame, labels: DataFrame, m: int, folds: int, held: int) -> LabelModel:
    """The label model from (doc_id, v): the votes of every row."""
    patterns = voted.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    patterns = settled(patterns.repartition(max(1, -(-patterns.count() // TASK_ROWS))))
    marks = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max("toxic").alias("q"))
    known = voted.filter(F.col("doc_id").isNotNull() & ~held_out(folds, held)).join(marks, "doc_id").groupBy("v").agg(
        F.count(F.lit(1)).alias("n"), F.avg("q").alias("q"))
    prior, counts = _tally(known, F.col("q").cast("double"), m)
    if not 0 < prior < 1:
        raise ValueError("the training fold needs labelled rows of both classes")
    model = _model(prior, counts, [1.0] * m)
    for _ in range(2):
        for _ in range(ROUNDS):
            prior, counts = _tally(patterns, model.posterior(F.col("v")), m)
            before, model = model, _model(prior, counts, model.weights)
            if _moved(before, model) < SETTLED:
                break
        model = _model(model.prior, counts, _correlations(patterns, model, m))
    return model


def _features(docs: DataFrame, lexicon_: list[str]) -> DataFrame:
    """``docs`` with the votes ``_v`` (computed once, then referred to) and the tokens ``_tokens`` to hash."""
    voted = _voted(docs, lexicon_)
    tokens = F.concat(F.col("_t"), F.transform("_v", lambda x, i: F.concat(
        F.lit("\u0000vote"), i.cast("string"), F.lit(":"), x.cast("string"))))
    return voted.withColumn("_tokens", tokens).drop("_t", "_l")


def _voted(docs: DataFrame, lexicon_: list[str]) -> DataFrame:
    """``docs`` with terms ``_t``, lower-cased text ``_l`` and votes ``_v``, each computed once per row."""
    both = docs.withColumn("_l", F.lower(F.coalesce(F.col("text"), F.lit("")))).withColumn("_w", _distinct_words(F.col("_l")))
    both = both.withColumn("_t", terms(F.col("_w"))).drop("_w").withColumn("_f", watched(F.col("_t"), lexicon_))
    return both.withColumn("_v", votes(F.col("text"), lexicon_, F.col("_f"), F.col("_l"))).drop("_f")


def featured(docs: DataFrame, lexicon_: list[str], hashed: HashingTF) -> DataFrame:
    """(doc_id, _v, features, _pick) of every row: votes, hashed words and votes, and the hash that chooses the
    classifier's training rows; the text is read once for all of them."""
    pick = F.abs(F.xxhash64(F.coalesce("text", F.lit("")))) % 1_000_000
    return hashed.transform(_features(docs.select("doc_id", "text"), lexicon_)).select(
        "doc_id", "_v", "features", pick.alias("_pick"))


def _hashing() -> HashingTF:
    return HashingTF(inputCol="_tokens", outputCol="features", numFeatures=FEATURES, binary=True)


def _prepared(docs: DataFrame, labels: DataFrame, folds: int, held: int):
    """Lexicon, hashing and the featured rows of ``docs``, kept in the shared folder: the label model, the
    classifier's training rows and (for :func:`learn_and_score`) the scores all read them from there."""
    docs = docs.select("doc_id", "text")
    words_ = lexicon(docs, labels, folds, held)
    hashed = _hashing()
    return words_, hashed, _kept(featured(docs, words_, hashed))


def _kept(table: DataFrame) -> DataFrame:
    """``table`` written once to the shared folder as Parquet, which packs the hashed words far better than a checkpoint
    and lets the label model read the votes alone. The hashed words ascend in each row, so their differences are stored.
    Like a checkpoint it stays there until the folder is cleared."""
    path = f"{shared_folder(table.sparkSession)}/featured-{uuid.uuid4().hex}"
    table.write.options(**{"compression": "zstd", "parquet.writer.version": "v2",
                           "parquet.enable.dictionary#features.indices.list.element": "false"}).parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def _fit(table: DataFrame, labels: DataFrame, words_: list[str], hashed: HashingTF, folds: int, held: int):
    model = _label_model(table.select("doc_id", F.col("_v").alias("v")), labels, len(words_) + len(PATTERNS) + 2, folds, held)
    total = table.count()
    share = min(1.0, TRAIN_ROWS / max(total, 1))
    rows = table.filter(F.col("_pick") < share * 1_000_000).select("features", model.posterior(F.col("_v")).alias("q"))
    # Each chosen row twice (label 1 weighted by its posterior, label 0 by the complement); the regression keeps
    # its own copy of these rows for its iterations.
    pairs = F.array(F.struct(F.lit(1.0).alias("label"), F.col("q").alias("weight")),
                    F.struct(F.lit(0.0).alias("label"), (1 - F.col("q")).alias("weight")))
    soft = rows.select("features", F.explode(pairs).alias("p")).select("features", "p.label", "p.weight")
    # The chosen rows are spread thinly over all the table's partitions; gathered into tasks of about FIT_ROWS rows
    # (no shuffle), each iteration combines a few gradients instead of one per partition of the table.
    soft = soft.coalesce(max(1, -(-2 * min(total, TRAIN_ROWS) // FIT_ROWS)))
    classifier = LogisticRegression(weightCol="weight", regParam=1e-3, maxIter=40, standardization=False).fit(soft)
    return words_, model, hashed, classifier


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0):
    """Lexicon, label model and classifier; labels only from the training fold, and only to start the label model
    and choose the lexicon."""
    words_, hashed, table = _prepared(docs, labels, folds, held)
    return _fit(table, labels, words_, hashed, folds, held)


def _scored(rows: DataFrame, classifier) -> DataFrame:
    score = vector_to_array("probability")[1]
    return classifier.transform(rows.select("doc_id", "features")).select(
        "doc_id", score.alias("score"), (score >= ACCEPT).cast("int").alias("predicted"))


def score_documents(docs: DataFrame, learned) -> DataFrame:
    """doc_id, score (the classifier's probability of toxic) and predicted (score >= ACCEPT) of every row."""
    words_, _, hashed, classifier = learned
    return _scored(featured(docs, words_, hashed), classifier)


def learn_and_score(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """:func:`learn` on ``docs`` and the scores of all of them, with each text read once after the lexicon:
    the scores come from the kept featured rows. Same rows and columns as :func:`score_documents`."""
    words_, hashed, table = _prepared(docs, labels, folds, held)
    return _scored(table, _fit(table, labels, words_, hashed, folds, held)[3])
