"""Run registered queries against their SQL on the same tables and compare every value.

    python tests/oracle_check.py [sf] [name ...]
"""
from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TESTDATA = os.environ.get("TESTDATA_DIR", "/root/testdata")


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("i", v)
    if isinstance(v, float):
        return ("f", 0.0 if v == 0 else v)
    if isinstance(v, datetime.datetime):
        return ("t", v.replace(tzinfo=None).isoformat())
    if isinstance(v, datetime.date):
        return ("d", v.isoformat())
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return ("s", str(v))


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def near(a, b):
    if isinstance(a, tuple) and isinstance(b, tuple):
        if len(a) == 2 and a[0] == "f" and b[0] == "f":
            return abs(a[1] - b[1]) <= 1e-6 * max(1, abs(a[1]))
        return len(a) == len(b) and all(near(x, y) for x, y in zip(a, b))
    return a == b


def compare(spark, sf_dir, name, query, oracle):
    """(verdict, row count, first difference)."""
    df = query(spark, sf_dir)
    names, got = rows_of(df.columns, df.collect())
    if oracle is None:
        return "rows", len(got), ""
    con = duck(sf_dir)
    cur = con.execute(oracle)
    onames, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    con.close()
    if names != onames:
        return "COLUMNS", len(got), f"{names} vs {onames}"
    if got == want:
        return "ok", len(got), ""
    if len(got) != len(want):
        extra = [x for x in got if x not in set(want)][:1] if len(got) < 5000 else ""
        gone = [x for x in want if x not in set(got)][:1] if len(want) < 5000 else ""
        return "ROWCOUNT", len(got), f"{len(got)} vs {len(want)} extra {extra} missing {gone}"
    bad = [(a, b) for a, b in zip(got, want) if not near(a, b)]
    if not bad:
        return "approx", len(got), str([(a, b) for a, b in zip(got, want) if a != b][:1])
    diff = [(n, x, y) for n, x, y in zip(names, *bad[0]) if not near(x, y)]
    return "VALUES", len(got), f"{len(bad)} rows differ; e.g. {diff[:4]} in {bad[0][0][:6]}"


def main(argv):
    import __spark_entry__ as entry
    from reeltide.session import build_session
    sf = argv[0] if argv else "sf0.01"
    spark = build_session("check", f"local[{os.cpu_count()}]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    picked = argv[1:] or list(queries)
    names = [n for n in queries if any(n == p or (p.endswith("*") and n.startswith(p[:-1])) for p in picked)] if argv[1:] else picked
    failed = 0
    for n in names:
        t = time.time()
        try:
            verdict, count, note = compare(spark, f"{TESTDATA}/{sf}", n, queries[n], oracles.get(n))
        except Exception as e:  # noqa: BLE001
            verdict, count, note = "ERROR", 0, f"{type(e).__name__}: {str(e)[:700]}"
        failed += verdict not in ("ok", "rows")
        if verdict != "ok" or "-v" in os.environ.get("CHECK", "-v"):
            print(f"{verdict:9} {n:34} rows={count:<7} {time.time() - t:5.1f}s {note[:900]}", flush=True)
    print(f"{len(names) - failed}/{len(names)} fine")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
