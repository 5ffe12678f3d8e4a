"""Compare registered queries with their SQL twins: python tests/oracle_check.py [--sf DIR] [name ...]"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from '{path}'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return repr(v) if not isinstance(v, int) or isinstance(v, bool) else repr(int(v))


def canonical(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def spark_rows(df) -> tuple[list[str], list]:
    return df.columns, [tuple(r) for r in df.collect()]


def duck_rows(con, sql: str) -> tuple[list[str], list]:
    cur = con.execute(sql)
    rows = cur.fetchall()
    return [d[0] for d in cur.description], rows


def difference(left, right) -> str | None:
    (lc, lr), (rc, rr) = canonical(*left), canonical(*right)
    if lc != rc:
        return f"columns {sorted(set(lc) ^ set(rc))}"
    if len(lr) != len(rr):
        return f"rows {len(lr)} vs {len(rr)}"
    bad = [(a, b) for a, b in zip(lr, rr) if a != b]
    if bad:
        a, b = bad[0]
        cells = [(c, x, y) for c, x, y in zip(lc, a, b) if x != y]
        return f"{len(bad)} of {len(lr)} rows differ, first: {cells[:4]}"
    return None


def main() -> int:
    from priorform.catalog import ORACLES, QUERIES
    from priorform.session import local_session

    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="/root/testdata/sf0.01")
    args.add_argument("names", nargs="*")
    opts = args.parse_args()
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(opts.sf)
    failed = 0
    for name in opts.names or list(QUERIES):
        t0 = time.time()
        try:
            left = spark_rows(QUERIES[name](spark, opts.sf))
        except Exception as e:  # noqa: BLE001
            failed += 1
            print(f"FAIL {name}: spark {type(e).__name__} {str(e)[:600]}", flush=True)
            continue
        t1 = time.time()
        if name not in ORACLES:
            print(f"rows {name}: {len(left[1])} rows, {t1 - t0:.1f}s", flush=True)
            continue
        try:
            right = duck_rows(con, ORACLES[name])
        except Exception as e:  # noqa: BLE001
            failed += 1
            print(f"FAIL {name}: sql {type(e).__name__} {str(e)[:600]}", flush=True)
            continue
        d = difference(left, right)
        failed += d is not None
        print(f"{'FAIL' if d else 'ok  '} {name}: {len(left[1])} rows, spark {t1 - t0:.1f}s sql {time.time() - t1:.1f}s {d or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
