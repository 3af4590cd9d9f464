"""Merkle manifest against a plain, level-by-level tree built in Python."""

from __future__ import annotations

import hashlib
import zlib

import pytest

from hotelspark.llm import manifest
from tests.conftest import SF_DIR
from tests.llm import cases


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _field(value) -> str:
    if value is None:
        return "-"
    text = value if isinstance(value, str) else str(int(value))
    return f"{len(text.encode())}:{text}"


def _leaf(row, forged: bool = False) -> str:
    n = row["n_chars"]
    if forged and row["doc_id"] is not None and n is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0:
        n += 1
    return _h("".join(_field(row[c]) if c != "n_chars" else _field(n) for c in ("doc_id", "source", "lang", "n_chars", "text")))


def _levels(hashes: list[str]) -> list[list[str]]:
    levels = [hashes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([_h("".join(last[i:i + 2])) for i in range(0, len(last), 2)])
    return levels


def _path(levels: list[list[str]], i: int) -> list[tuple[str, bool]]:
    out = []
    for level in levels[:-1]:
        out.append((level[i ^ 1] if (i ^ 1) < len(level) else "", i % 2 == 0))
        i //= 2
    return out


def brute(rows: list[dict]) -> list[tuple]:
    groups: dict[bytes, list[dict]] = {}
    for row in rows:
        key = b"0" if row["lang"] is None else b"1" + row["lang"].encode()
        groups.setdefault(key, []).append({**row, "leaf": _leaf(row), "forged": _leaf(row, True)})
    names = sorted(groups)
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["leaf"]))
        trees[g] = _levels([r["leaf"] for r in groups[g]])
    top = _levels([trees[g][-1][0] for g in names])
    out = []
    for gi, g in enumerate(names):
        for i, row in enumerate(groups[g]):
            proof = _path(trees[g], i) + _path(top, gi)
            h = row["forged"]
            for sibling, left in proof:
                h = _h(h) if not sibling else _h(h + sibling) if left else _h(sibling + h)
            out.append((row["doc_id"], row["leaf"], trees[g][-1][0], top[-1][0], _h("".join(s for s, _ in proof)), h,
                        h == top[-1][0]))
    return sorted(out, key=repr)


def _run(docs, block: int) -> list[tuple]:
    found = manifest.manifest(docs, block).collect()
    return sorted((tuple(r) for r in found), key=repr)


@pytest.mark.parametrize("block", [2, 4, 256])
def test_hard_cases_match_the_plain_tree(spark, block):
    docs = cases.clashing(cases.documents(spark))
    rows = [r.asDict() for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert _run(docs, block) == brute(rows)


def test_given_table_matches_and_only_tampered_rows_fail(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [r.asDict() for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    found = _run(docs, 8)
    assert found == brute(rows)
    n_chars = {r["doc_id"]: r["n_chars"] for r in rows}
    for doc_id, *_, verified in found:
        hit = zlib.crc32(str(doc_id).encode()) % 7 == 0 and n_chars[doc_id] is not None
        assert verified is not hit


def test_one_leaf_is_its_own_subroot_and_root(spark):
    docs = spark.createDataFrame([(5, "x", "en", "a", 1)], cases.DOCUMENTS)
    (row,) = manifest.manifest(docs).collect()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == _h("")


def test_empty_table_gives_no_rows(spark):
    assert manifest.manifest(cases.empty(spark)).count() == 0


def test_append_block_matches_levels():
    hashes = [_h(str(i)) for i in range(11)]
    root, siblings, lefts = manifest.append_block(hashes, 4)
    levels = _levels(hashes)
    assert root == levels[-1][0]
    for i in range(11):
        assert list(zip(siblings[i], lefts[i], strict=True)) == _path(levels, i)
