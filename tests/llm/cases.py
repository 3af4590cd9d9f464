"""Small tables with the hard cases: nulls, empty and very long texts, ties, repeated rows, clashing extra columns."""

from __future__ import annotations

import random

from pyspark.sql import types as T

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars int"


def texts(seed: int = 3, count: int = 60) -> list[str | None]:
    rng = random.Random(seed)
    words = ["".join(rng.choice(["th", "er", "an", "re", "on", "é", "ß"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]

    def prose(n: int) -> str:
        return " ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".\n"]) for _ in range(n))

    passage, line = prose(120), prose(15)
    out: list[str | None] = [None, "", "   \t\n", "One", "one two", "x" * 3000, "word " * 900, prose(20_000)]
    for _ in range(count):
        kind, body = rng.random(), prose(rng.randint(5, 220))
        if kind < 0.25:
            body = f"{prose(30)} {passage} {body}"
        elif kind < 0.4:
            body = f"{body}\n{line}"
        out.append(body)
    long = prose(400)
    out += [long, long, long.replace("e", "a", 1), long.replace("o", "u", 2), long[:900] + long[905:], passage]
    return out


def documents(spark, seed: int = 3, count: int = 60):
    """Documents with nulls in every column, repeated rows and one hot source."""
    rng = random.Random(seed)
    rows = []
    for i, text in enumerate(texts(seed, count)):
        source = rng.choice(["a", "a", "a", "b", "ä", "z", None, "c"])
        rows.append((None if i == 11 else i, text, rng.choice(["en", "de", None]), source, None if text is None else len(text)))
    rows += [rows[20], rows[20], rows[9], (7000, rows[21][1], None, None, None)]
    return spark.createDataFrame(rows, DOCUMENTS)


def clashing(docs):
    """The same rows with extra columns under names that the operators use inside."""
    names = ("k0", "k1", "chunk", "carried", "found", "size", "taken", "take", "score", "predicted", "fp", "node", "label", "part", "features", "_", "row")
    return docs.selectExpr("*", *[f"'{n}' AS `{n}`" for n in names])


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])
