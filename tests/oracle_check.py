"""Run registered queries next to their SQL, the way the correctness gate does.

    python tests/oracle_check.py [name-prefix ...] [--sf DIR]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

from lucerna.plans.corpus import TABLES
from lucerna.plans.registry import load_all
from lucerna.session import local_session


def norm(v):
    if v is None:
        return "~null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, int):
        return f"{float(v):.6g}" if abs(v) < 10**6 else str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, sf):
    df = fn(spark, sf)
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return True, f"rows {len(got[1])}"
    cur = con.execute(sql)
    want = canon([c[0] for c in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return False, f"columns {got[0]} vs {want[0]}"
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return False, f"rows {len(got[1])} vs {len(want[1])}; spark only {sorted(a - b)[:3]}; sql only {sorted(b - a)[:3]}"
    return True, f"rows {len(got[1])}"


def main(argv):
    sf = "/root/testdata/sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        del argv[i : i + 2]
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    spark = local_session(8)
    bad = 0
    for name, (fn, sql) in load_all().items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        t = time.time()
        try:
            ok, msg = compare(spark, con, fn, sql, sf)
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"{type(e).__name__}: {str(e)[:700]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {time.time() - t:6.1f}s {'(rows only) ' if sql is None else ''}{msg}"[:1500], flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
