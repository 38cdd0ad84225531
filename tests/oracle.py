"""Run catalogue queries next to their SQL statements in DuckDB and compare the rows exactly.

``python tests/oracle.py /root/testdata/sf0.01 [name …]``
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return v


def _bag(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple((type(_norm(row[i])).__name__, _norm(row[i])) for i in order) for row in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    """Return (ok, message)."""
    df = fn(spark, sf_dir)
    got = [tuple(x) for x in df.collect()]
    if sql is None:
        return bool(got), f"{len(got)} rows, no SQL"
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(cols) != sorted(df.columns):
        return False, f"columns differ: {sorted(df.columns)} / {sorted(cols)}"
    a, b = _bag(got, df.columns), _bag(want, cols)
    if a == b:
        return bool(got), f"{len(got)} rows"
    left, right = sorted((a - b), key=str)[:3], sorted((b - a), key=str)[:3]
    return False, f"{len(got)} / {len(want)} rows, {sum((a - b).values())} differ\n   spark {left}\n   sql   {right}"


def main(argv):
    from ticklattice.plans.catalog import ORACLES, QUERIES
    from ticklattice.session import build_session

    sf_dir, names = argv[0], argv[1:]
    spark = build_session("check", cores="8", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in QUERIES:
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        t = time.time()
        try:
            ok, msg = compare(spark, con, name, QUERIES[name], ORACLES.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {time.time() - t:6.2f}s {msg}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1:]), 1))
