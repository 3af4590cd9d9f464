"""Conversation structure repair as a lightest derivation (Knuth's generalisation of Dijkstra's algorithm).

Rows are first damaged on purpose (so that the repair has work to do) by the CRC-32 of ``conv_id:turn``: modulo 20,
0 drops the row, 1 empties its text, 2 removes its ``.``, ``!`` and ``?``, 3 repeats it next to itself, 4 makes its role
``user``. A conversation's damaged rows, by turn, must become a sequence whose role initials read ``(s?(ua)+)?``.

Items are (rows read, state of that pattern); deductions are the edits: keep a row (0), give it the role user or
assistant (1), delete it (2, the only edit of a blank or repeated row), insert an empty user or assistant row (5); a
truncated row that stays costs 5 more. The agenda pops the item of least (cost, audit), the audit being the initials
of the edits so far; appending an edit never lowers it, and among equal costs no audit is a prefix of another (the
longer one would hold more inserts, hence cost more), so the order is monotone and the first time the goal item is
popped its derivation is the cheapest, with the ASCII-least audit among the cheapest.

Spark damages and orders the rows and keeps each conversation in one task, where the agenda runs; the repaired text
is hashed there as it is produced.

Cases: null conv_id is a conversation of its own; a null turn sorts first and is not counted in gaps; null role and
text are read as one space (so a null text is blank, a null role cannot be kept); rows of equal turn are ordered by
role, text and copy; a conversation whose rows all drop gives zeros, an empty audit and the hash of the empty text;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotelspark.llm.common import run_starts, whole_runs

# Fixed values of the contract: the pattern's states and moves, and the edit costs.
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPTING = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

_SPACE = " \t\n\x0b\x0c\r"
_SCHEMA = pa.schema([("k0", pa.int64()), ("k1", pa.int32()), ("gaps", pa.int64()), ("blank", pa.int64()),
                     ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()),
                     ("audit", pa.string()), ("repaired_sha256", pa.string())])
_DDL = ("k0 long, k1 int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
        "repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage, with (k0, k1) naming the conversation and ``copy`` telling repeats apart."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.withColumn("_d", F.crc32(key.cast("binary")) % 20).filter("_d <> 0")
    return rows.select(
        F.coalesce("conv_id", F.lit(0)).alias("k0"), F.col("conv_id").isNull().cast("int").alias("k1"), "turn",
        F.when(F.col("_d") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("_d") == 1, F.lit("")).when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(
            F.col("text")).alias("text"),
        F.explode(F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def faults(roles: list[str], texts: list[str]) -> list[str]:
    """Each row's first fault: 'blank', 'duplicate', 'truncated' or ''."""
    seen, out = set(), []
    for role, text in zip(roles, texts, strict=True):
        inked = text.rstrip(_SPACE)
        if not inked:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        elif inked[-1] not in ".!?":
            out.append("truncated")
        else:
            out.append("")
        seen.add((role, text))
    return out


def lightest(initials: list[str], fault: list[str]) -> tuple[int, str, list[tuple[str, int]]]:
    """Knuth's agenda over items (i, state). Returns the cost, the audit and the repaired rows as (role, row index;
    -1 for an inserted row, whose role is then given)."""
    n = len(initials)
    goal = (n + 1, -1)
    agenda: list[tuple[int, str, int, tuple[int, int], tuple[int, int] | None, str]] = [(0, "", 0, (0, 0), None, "")]
    pushed = 0
    done: dict[tuple[int, int], tuple[tuple[int, int] | None, str]] = {}
    while agenda:
        cost, audit, _, item, parent, emit = heapq.heappop(agenda)
        if item in done:
            continue
        done[item] = (parent, emit)
        if item == goal:
            rows: list[tuple[str, int]] = []
            at = done[item][0]
            while at is not None and done[at][0] is not None:
                back, what = done[at]
                if what:
                    rows.append((what, at[0] - 1 if what[0] != "+" else -1))
                at = back
            rows.reverse()
            return cost, audit, [(r.lstrip("+"), i) for r, i in rows]
        i, q = item
        pushes = []
        if i == n:
            if q in ACCEPTING:
                pushes.append((0, "", goal, ""))
        else:
            extra = TRUNCATED if fault[i] == "truncated" else 0
            if fault[i] not in ("blank", "duplicate"):
                if (q, initials[i]) in MOVES:
                    pushes.append((KEEP + extra, "K", (i + 1, MOVES[q, initials[i]]), "="))
                for role in "ua":
                    if (q, role) in MOVES:
                        pushes.append((REROLE + extra, "R", (i + 1, MOVES[q, role]), role))
            pushes.append((DELETE, "D", (i + 1, q), ""))
        for role in "ua":
            if (q, role) in MOVES:
                pushes.append((INSERT, "I", (i, MOVES[q, role]), "+" + role))
        for step, letter, target, emit in pushes:
            if target not in done:
                pushed += 1
                heapq.heappush(agenda, (cost + step, audit + letter, pushed, target, item, emit))
    raise AssertionError("the goal is always derivable: deleting every row is a repair")


def repair_one(turns: list[int | None], roles: list[str], texts: list[str]) -> dict:
    """The measures and the lightest repair of one conversation's damaged rows, already in order."""
    fault = faults(roles, texts)
    initials = [r[:1] for r in roles]
    illegal = sum(1 for a, b in zip(initials, initials[1:], strict=False) if a + b not in ("su", "ua", "au"))
    known = [t for t in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    cost, audit, rows = lightest(initials, fault)
    digest = hashlib.sha256()
    for k, (what, i) in enumerate(rows):
        role = roles[i] if what == "=" else ROLES[what]
        digest.update(f"{chr(10) if k else ''}{role}:{texts[i] if i >= 0 else ''}".encode())
    return {"gaps": gaps, "blank": fault.count("blank"), "duplicate": fault.count("duplicate"),
            "truncated": fault.count("truncated"), "illegal": illegal, "cost": cost, "audit": audit,
            "repaired_sha256": digest.hexdigest()}


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in whole_runs(batches, ["k0", "k1"]):
        starts = list(run_starts(rows, ["k0", "k1"])) + [rows.num_rows]
        cols = {c: rows.column(c).to_pylist() for c in ("k0", "k1", "turn", "role", "text")}
        out = []
        for a, b in zip(starts, starts[1:], strict=False):
            found = repair_one(cols["turn"][a:b], cols["role"][a:b], cols["text"][a:b])
            out.append({"k0": cols["k0"][a], "k1": cols["k1"][a], **found})
        yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)


def repair(conversations: DataFrame) -> DataFrame:
    """One row per original conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = damaged(conversations).repartition("k0", "k1").sortWithinPartitions(
        "k0", "k1", F.col("turn").asc_nulls_first(), "role", "text", "copy")
    found = rows.mapInArrow(_repair, _DDL)
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().select(
        "conv_id", F.coalesce("conv_id", F.lit(0)).alias("k0"), F.col("conv_id").isNull().cast("int").alias("k1"))
    zero = F.lit(0).cast("long")
    return ids.join(found, ["k0", "k1"], "left").select(
        "conv_id", *[F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
