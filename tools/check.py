"""Run registered queries and compare each with its SQL on DuckDB.

    python tools/check.py [--sf 0.01] [--only text,text] [--split]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
import traceback
from pathlib import Path

import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(frame):
    frame = frame[sorted(frame.columns)]

    def cell(v):
        if v is None or v is pd.NA:
            return None
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, (list, tuple)):
            return tuple(cell(x) for x in v)
        if isinstance(v, bool):
            return v
        if isinstance(v, float):
            return None if math.isnan(v) else float(f"{v:.12g}") + 0.0
        if isinstance(v, int):
            return v
        return str(v)

    rows = [tuple(cell(v) for v in row) for row in frame.astype(object).itertuples(index=False, name=None)]
    return sorted(rows, key=repr)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--only", default="")
    ap.add_argument("--split", action="store_true", help="force the range-partitioned paths")
    args = ap.parse_args()
    import duckdb

    from touchstone.plans.catalog import ORACLES, QUERIES
    from touchstone.settings import SMALL_BYTES, SPLIT_ROWS, local_session

    folder = f"/root/testdata/sf{args.sf}"
    spark = local_session()
    if args.split:
        spark.conf.set(SMALL_BYTES, "0")
        spark.conf.set(SPLIT_ROWS, "10")
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    wanted = [w for w in args.only.split(",") if w]
    bad = 0
    for name, fn in QUERIES.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            got = fn(spark, folder).toPandas()
            took = time.time() - start
            if name not in ORACLES:
                print(f"rows  {name:38s} {took:6.2f}s rows={len(got)}")
                continue
            start = time.time()
            want = con.execute(ORACLES[name]).df()
            duck = time.time() - start
            a, b = canonical(got), canonical(want)
            kinds = {c: (got[c].dtype.kind, want[c].dtype.kind) for c in got.columns if c in want.columns and got[c].dtype.kind != want[c].dtype.kind}
            if sorted(got.columns) != sorted(want.columns):
                bad += 1
                print(f"COLS  {name}: {sorted(set(got.columns) ^ set(want.columns))}")
            elif a != b:
                bad += 1
                diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
                print(f"DIFF  {name}: rows {len(a)} vs {len(b)} cols {sorted(got.columns)}\n   {diff}")
            else:
                print(f"ok    {name:38s} {took:6.2f}s duck {duck:5.2f}s rows={len(got)} {'KINDS ' + str(kinds) if kinds else ''}")
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: {type(e).__name__} {str(e)[:700]}")
            if wanted:
                traceback.print_exc(limit=4)
        sys.stdout.flush()
    print("failures:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
