"""Run registered queries next to their SQL and compare every row.

``python tests/compare.py [sf] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def difference(df, con, sql: str) -> str | None:
    """None if both give the same rows, else what differs first."""
    mine = rows_of(df.columns, df.collect())
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    theirs = rows_of(names, got.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows / {len(theirs)} rows"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"{str(a)[:300]} / {str(b)[:300]}"
    return None


def main(argv: list[str]) -> int:
    from conftest import make_session

    import __spark_entry__ as entry

    sf = argv[0] if argv else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark, con = make_session(), duck(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in argv[1:] or list(queries):
        t = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracles:
                why = difference(df, con, oracles[name])
                note = f"{df.count()} rows" if why is None else f"DIFFERS: {why}"
            else:
                note = f"{df.count()} rows (no SQL)"
                why = None
        except Exception as e:  # keep going, report every query
            why = note = "FAILED: " + str(e)[:700]
        bad += why is not None
        print(f"{name:28s} {time.time() - t:6.1f}s  {note}", flush=True)
    return bad


if __name__ == "__main__":
    sys.path.insert(0, str(ROOT / "tests"))
    sys.exit(main(sys.argv[1:]))
