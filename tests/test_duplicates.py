"""Similar guests inside a birth date against plain pairs: containment, one edit, equal names, and a hot default date."""

from __future__ import annotations

import random
import re

from hotelspark.operators.duplicates import similar_guests


def _lev(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def brute(rows):
    norm = {}
    for i, name, date in rows:
        n = re.sub(r"[^A-Z0-9]+", " ", (name or "").upper()).strip()
        if i is not None and date is not None and n:
            norm[(i, date, n)] = True
    items = list(norm)
    parent = {x: x for x in items}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a in items:
        for b in items:
            if a < b and a[1] == b[1] and (a[2] == b[2] or _lev(a[2], b[2]) <= 1 or f" {a[2]} " in f" {b[2]} " or f" {b[2]} " in f" {a[2]} "):
                parent[find(a)] = find(b)
    groups = {}
    for x in items:
        groups.setdefault(find(x), []).append(x)
    out = set()
    for members in groups.values():
        if len(members) > 1:
            low = min(m[0] for m in members)
            out |= {(m[0], m[1], low, len(members)) for m in members}
    return out


def test_hot_default_date_matches_plain_pairs(spark):
    rng = random.Random(2)
    first = ["ANN", "BOB", "CARLA", "DEDI", "EKA", "FAJAR", "GITA"]
    rows = []
    for i in range(400):
        date = "1900-01-01" if i % 3 else rng.choice(["1980-05-05", "1990-01-02", None])
        name = f"{rng.choice(['MR ', 'Mrs. ', '', ''])}{rng.choice(first)} {rng.choice(first)}{rng.choice(['', 'A', 'E'])}"
        rows.append((i, name, date))
    rows += [(1000, "ann", "1900-01-01"), (1001, "!!!", "1900-01-01"), (None, "ANN BOB", "1900-01-01"), (5, rows[5][1], rows[5][2])]
    prof = spark.createDataFrame(rows, "id long, name string, birth_date string")
    got = {tuple(r) for r in similar_guests(prof).collect()}
    assert got == brute(rows)
    assert got
