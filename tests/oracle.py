"""Compare registered queries with their DuckDB SQL: ``python tests/oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from hotelspark.fixtures import TABLES  # noqa: E402
from hotelspark.workload import ORACLES, QUERIES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _key(row) -> str:
    return repr([float(x) + 0.0 if isinstance(x, float) else x for x in row])


def compare(spark, con, name: str, sf_dir: str) -> str | None:
    """None when both sides agree in columns, types and rows, else what differs."""
    df = QUERIES[name](spark, sf_dir)
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    order = sorted(columns)
    want = Counter(_key([r[columns.index(c)] for c in order]) for r in cursor.fetchall())
    have = Counter(_key([r[c] for c in order]) for r in df.select(*order).collect())
    if want == have:
        return None
    extra, missing = list((have - want).elements()), list((want - have).elements())
    return f"{order}\n  spark rows {sum(have.values())}, sql rows {sum(want.values())}, only spark {len(extra)}: {sorted(extra)[:3]}\n  only sql: {sorted(missing)[:3]}"


def main() -> None:
    from tests.conftest import make_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con = make_session(), duck(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, name, sf_dir) if name in ORACLES else f"(no SQL) rows {QUERIES[name](spark, sf_dir).count()}"
        except Exception as error:  # report and go on with the others
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += bool(problem)
        print(f"{name:45s} {time.time() - start:6.2f}s {problem or 'ok'}", flush=True)
    print(f"{len(names)} queries, {bad} to look at")


if __name__ == "__main__":
    main()
