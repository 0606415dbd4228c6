"""Run every registered query and its SQL on one data folder and report differences.

usage: python tools/check.py [data_dir] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from paperlode import build_session  # noqa: E402
from paperlode.plans import QUERIES  # noqa: E402
from paperlode.sources.tables import SCHEMAS  # noqa: E402


def normal(rows, columns) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        return repr(float(f"{v:.9g}")) if isinstance(v, float) else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def main() -> int:
    base = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for table in SCHEMAS:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{base}/{table}.parquet'")
    bad = 0
    for name in names:
        try:
            began = time.time()
            df = QUERIES[name](spark, base)
            mine = normal([tuple(r) for r in df.collect()], df.columns)
            took = time.time() - began
            if QUERIES[name].sql is None:
                print(f"ROWS  {name} {len(mine)} {took:.1f}s", flush=True)
                continue
            result = con.execute(QUERIES[name].sql)
            columns = [d[0] for d in result.description]
            theirs = normal(result.fetchall(), columns)
            if sorted(columns) != sorted(df.columns):
                bad += 1
                print(f"COLS  {name} {sorted(df.columns)} {sorted(columns)}", flush=True)
            elif mine != theirs:
                bad += 1
                left, right = set(mine), set(theirs)
                print(f"DIFF  {name} {len(mine)} vs {len(theirs)}", flush=True)
                print("   only spark", sorted(left - right)[:2], "\n   only sql", sorted(right - left)[:2], flush=True)
            else:
                print(f"OK    {name} {len(mine)} rows {took:.1f}s", flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name} {type(e).__name__} {str(e)[:600]}", flush=True)
    print(f"{len(names) - bad}/{len(names)} fine")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
