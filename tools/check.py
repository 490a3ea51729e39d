"""Compares registered queries with their SQL: python tools/check.py [--sf DIR] [name part ...]"""
import argparse
import datetime as dt
import decimal
import importlib
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from marketlens.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events".split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("i", v)
    if isinstance(v, float):
        return ("f", None if math.isnan(v) else (0.0 if v == 0 else round(v, 6)))
    if isinstance(v, decimal.Decimal):
        return ("d", str(v))
    if isinstance(v, dt.datetime):
        return ("t", v.replace(tzinfo=None).isoformat())
    if isinstance(v, dt.date):
        return ("D", v.isoformat())
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    return v


def compare(df, con, sql):
    cols = sorted(df.columns)
    got = [tuple(norm(x) for x in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return f"columns {cols} vs {sorted(rel.columns)}", len(got)
    names = ", ".join('"' + c + '"' for c in cols)
    want = [tuple(norm(x) for x in r) for r in con.sql(f"select {names} from ({sql})").fetchall()]
    key = repr
    got.sort(key=key)
    want.sort(key=key)
    if got == want:
        return ("" if got else "EMPTY"), len(got)
    a, b = set(map(key, got)), set(map(key, want))
    only_a, only_b = sorted(a - b)[:3], sorted(b - a)[:3]
    return f"rows {len(got)} vs {len(want)}; {cols}\n   spark {only_a}\n   sql   {only_b}", len(got)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--slow", type=float, default=6)
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    entry = importlib.import_module("__spark_entry__")
    spark = local_session()
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{a.sf}/{t}.parquet')")
    oracle, bad = entry.oracle_sql(), []
    todo = [n for n in entry.queries() if not a.names or any(n.startswith(x) or x == n for x in a.names)]
    for name in todo:
        t0 = time.time()
        try:
            df = entry.queries()[name](spark, a.sf)
            if name in oracle:
                msg, n = compare(df, con, oracle[name])
            else:
                n = df.count()
                msg = "" if n else "EMPTY"
        except Exception as e:  # noqa: BLE001
            msg, n = "ERROR " + str(e)[:900], 0
        took = time.time() - t0
        if msg:
            bad.append(name)
            print(f"FAIL {name} ({took:.1f}s): {msg}", flush=True)
        elif took > a.slow:
            print(f"slow {name} {n} rows {took:.1f}s", flush=True)
    print(f"{len(todo) - len(bad)}/{len(todo)} ok; failing: {bad}")


if __name__ == "__main__":
    main()
