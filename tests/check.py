"""Run registered queries against their SQL on one data folder.

``python -m tests.check sf0.01 [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(normal(x) for x in v)
    return v


def kind(v):
    if v is None:
        return "null"
    return type(v).__name__


def compare(df, con, sql: str) -> tuple[bool, str]:
    cols = sorted(df.columns)
    got = [tuple(normal(row[c]) for c in cols) for row in df.collect()]
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    if sorted(names) != cols:
        return False, f"columns {cols} against {sorted(names)}"
    pick = [names.index(c) for c in cols]
    want = [tuple(normal(row[i]) for i in pick) for row in res.fetchall()]
    if len(got) != len(want):
        return False, f"rows {len(got)} against {len(want)}"
    kinds_got = {c: {kind(r[i]) for r in got} for i, c in enumerate(cols)}
    kinds_want = {c: {kind(r[i]) for r in want} for i, c in enumerate(cols)}
    if kinds_got != kinds_want:
        bad = [c for c in cols if kinds_got[c] != kinds_want[c]]
        return False, f"types {[(c, kinds_got[c], kinds_want[c]) for c in bad]}"
    order = lambda row: tuple(str(v) for v in row)
    got.sort(key=order)
    want.sort(key=order)
    wrong = [(a, b) for a, b in zip(got, want) if a != b]
    if wrong:
        return False, f"{len(wrong)}/{len(got)} rows differ, first {wrong[0]}"
    return True, f"{len(got)} rows"


def main() -> int:
    import __spark_entry__ as entry
    from graphloom.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    sf_dir = f"/root/testdata/{sf}"
    wanted = sys.argv[2:]
    spark = local_session(8)
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                ok, note = compare(df, con, oracles[name])
            else:
                rows = df.collect()
                ok, note = len(rows) > 0, f"{len(rows)} rows (no SQL) {rows[0] if rows else ''}"[:200]
        except Exception as err:  # noqa: BLE001
            ok, note = False, f"{type(err).__name__}: {str(err)[:600]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:34s} {time.time() - start:6.1f}s {note}", flush=True)
    spark.stop()
    print("failed", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
