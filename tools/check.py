"""Run registered queries and compare them with their SQL on the same tables.

usage: python tools/check.py [sf dir] [name prefix ...]
"""
from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from pitscreen.catalog import ORACLES, QUERIES  # noqa: E402
from pitscreen.session import get_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    def cell(v):
        if isinstance(v, float) and math.isnan(v):
            return "NaN"
        if isinstance(v, list):
            return tuple(v)
        return v
    return sorted(([cell(r[k]) for k in order] for r in rows), key=lambda r: [(x is None, str(type(x)), str(x)) for x in r])


def compare(df, con, sql):
    ours = normal([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    theirs = normal(cur.fetchall(), names)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(ours)
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}", len(ours)
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if bad:
        return f"{len(bad)} of {len(ours)} rows differ, e.g. {sorted(names)}\n   {bad[0][0]}\n   {bad[0][1]}", len(ours)
    kinds = [(type(a), type(b)) for x, y in zip(ours, theirs) for a, b in zip(x, y) if a is not None and b is not None and type(a) is not type(b)]
    return (f"types {kinds[0]}" if kinds else None), len(ours)


def main() -> int:
    args = sys.argv[1:]
    sf = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = get_session("check", "local[8]", 8, **{"spark.driver.memory": "12g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf), 0
    for name, fn in QUERIES.items():
        if args and not any(name.startswith(a) for a in args):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            if name in ORACLES:
                problem, n = compare(df, con, ORACLES[name])
            else:
                problem, n = None, len(df.collect())
            state = "ok  " if problem is None else "FAIL"
        except Exception as e:  # noqa: BLE001
            problem, state, n = "".join(traceback.format_exception_only(e))[:900], "FAIL", -1
        failed += state == "FAIL"
        flag = "" if name in ORACLES else " (no sql)"
        print(f"{state} {name}{flag} rows={n} {time.time() - t0:.1f}s" + (f"\n   {problem}" if problem else ""), flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
