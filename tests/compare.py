"""Compare a registered query with its SQL oracle on one data folder.

Usage: python tests/compare.py SF_DIR [key ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def cell(v):
    if isinstance(v, float):
        return round(v, 9)
    if hasattr(v, "asDict"):
        return tuple(cell(x) for x in v)
    if isinstance(v, list):
        return tuple(cell(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, cell(x)) for k, x in sorted(v.items()))
    return v


def rows(names, data) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in data)


def compare(df, con, sql: str):
    """(equal, n_rows, message)"""
    got_names = df.columns
    got = rows(got_names, df.collect())
    cur = con.execute(sql)
    want_names = [d[0] for d in cur.description]
    want = rows(want_names, cur.fetchall())
    if sorted(got_names) != sorted(want_names):
        return False, sum(got.values()), f"columns {sorted(got_names)} != {sorted(want_names)}"
    if got != want:
        return (
            False,
            sum(got.values()),
            f"{sum(got.values())} vs {sum(want.values())} rows\n only spark: "
            f"{list((got - want).items())[:3]}\n only sql:   {list((want - got).items())[:3]}",
        )
    return True, sum(got.values()), ""


def main() -> int:
    import __spark_entry__ as entry
    from hunkledger.session import local_session

    sf_dir, keys = sys.argv[1], sys.argv[2:]
    spark = local_session(8, "compare")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracle = entry.oracle_sql()
    bad = 0
    for key, fn in entry.queries().items():
        if keys and key not in keys:
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if key not in oracle:
                print(f"rows  {key}: {df.count()} rows {time.time() - t:.1f}s", flush=True)
                continue
            ok, n, message = compare(df, con, oracle[key])
        except Exception as e:  # noqa: BLE001 - report and go on
            ok, n, message = False, 0, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print(f"{'ok   ' if ok else 'FAIL '} {key}: {n} rows {time.time() - t:.1f}s {message}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
