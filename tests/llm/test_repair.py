"""Conversation repair against plain Python: damage, order, faults and a level-by-level dynamic programme."""

from __future__ import annotations

import hashlib
import zlib

import pytest

from hotelspark.llm import repair

STATES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NAMES = {"u": "user", "a": "assistant"}


def _damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if d == 0:
            continue
        text = "" if d == 1 else "".join(c for c in text if c not in ".!?") if d == 2 else text
        role = "user" if d == 4 else role
        out += [(conv, turn, role, text, k) for k in range(2 if d == 3 else 1)]
    return out


def _dp(initials, fault):
    """Best (cost, audit, rows) per state, row by row; inserts relaxed until nothing changes."""
    best = {0: (0, "", ())}

    def relax(level):
        changed = True
        while changed:
            changed = False
            for q, (c, a, r) in list(level.items()):
                for role in "ua":
                    if (q, role) in STATES:
                        t = STATES[q, role]
                        cand = (c + 5, a + "I", r + (("+", role),))
                        if t not in level or cand[:2] < level[t][:2]:
                            level[t], changed = cand, True
        return level

    best = relax(best)
    for i, (init, f) in enumerate(zip(initials, fault, strict=True)):
        nxt = {}
        extra = 5 if f == "truncated" else 0

        def offer(t, cand):
            if t not in nxt or cand[:2] < nxt[t][:2]:
                nxt[t] = cand
        for q, (c, a, r) in best.items():
            offer(q, (c + 2, a + "D", r))
            if f in ("blank", "duplicate"):
                continue
            if (q, init) in STATES:
                offer(STATES[q, init], (c + extra, a + "K", r + (("=", i),)))
            for role in "ua":
                if (q, role) in STATES:
                    offer(STATES[q, role], (c + 1 + extra, a + "R", r + ((role, i),)))
        best = relax(nxt)
    return min(v for q, v in best.items() if q in (0, 3))


def brute(rows):
    convs = {}
    for row in _damage(rows):
        convs.setdefault(row[0], []).append(row)
    out = {}
    for conv in {r[0] for r in rows}:
        got = sorted(convs.get(conv, []), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3], r[4]))
        turns, roles, texts = [r[1] for r in got], [r[2] for r in got], [r[3] for r in got]
        fault = repair.faults(roles, texts)
        initials = [x[:1] for x in roles]
        cost, audit, kept = _dp(initials, fault) if got else (0, "", ())
        lines = [f"{NAMES[b]}:" if a == "+" else f"{roles[b] if a == '=' else NAMES[a]}:{texts[b]}" for a, b in kept]
        known = [t for t in turns if t is not None]
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, fault.count("blank"),
                     fault.count("duplicate"), fault.count("truncated"),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def _spark(spark, frame):
    return {r.conv_id: tuple(r)[1:] for r in repair.repair(frame).collect()}


def test_given_table_matches_plain_python(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()]
    assert _spark(spark, frame) == brute(rows)


def test_hard_cases(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "hi"), (1, 1, "user", "hi"), (1, 3, None, None),
            (1, None, "assistant", "ok."), (2, 5, "assistant", "x."), (None, 1, "user", "a."), (None, 2, "tool", "b?"),
            (3, 0, "user", "   \t"), (4, 0, "user", "w " * 5000 + "end."), (4, 1, "assistant", "fine")]
    rows += [(5, t, "user" if t % 2 == 0 else "assistant", f"t{t}.") for t in range(40)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("k0", repair.F.lit("x"))
    assert _spark(spark, frame) == brute(rows)
    assert repair.repair(frame.limit(0)).count() == 0


@pytest.mark.parametrize("initials,fault,cost,audit", [
    ("ua", ["", ""], 0, "KK"), ("au", ["", ""], 2, "RR"), ("", [], 0, ""), ("s", [""], 2, "D"), ("u", ["truncated"], 2, "D")])
def test_lightest_small(initials, fault, cost, audit):
    got = repair.lightest(list(initials), fault)
    assert got[:2] == (cost, audit) and got[:2] == _dp(list(initials), fault)[:2]
