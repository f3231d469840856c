"""Compare registered queries with their oracle SQL (also a command line tool)."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
BASE = os.environ.get("SPECFORGE_DATA", "/root/testdata")


def session():
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[8]").appName("specforge-tests")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(folder: str):
    import duckdb
    con = duckdb.connect()
    from specforge.catalog.data import BASE as names
    for n in names:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{folder}/{n}.parquet'")
    return con


def cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(cell(i) for i in v)
    if isinstance(v, dict):
        return tuple(sorted((k, cell(i)) for k, i in v.items()))
    try:
        return round(float(v), 9) if type(v).__name__ == "Decimal" else str(v)
    except Exception:
        return str(v)


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, name, fn, sql, folder):
    start = time.time()
    df = fn(spark, folder)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    took = f"spark {time.time() - start:.1f}s "
    if sql is None:
        return True, took + f"{len(mine)} rows, no oracle"
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    want = rows(cols, rel.fetchall())
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(cols)}"
    if mine == want:
        return (len(want) > 0), took + f"{len(want)} rows"
    a, b = set(map(repr, mine)), set(map(repr, want))
    return False, (f"rows {len(mine)} vs {len(want)}; only spark {len(a - b)}: "
                   f"{sorted(a - b)[:2]}; only oracle: {sorted(b - a)[:2]}")[:1800]


def main(argv):
    from specforge import catalog
    catalog.load()
    sf = os.environ.get("SF", "sf0.001")
    folder = f"{BASE}/{sf}"
    spark, con = session(), duck(folder)
    names = [n for n in catalog.QUERIES if not argv or any(a in n for a in argv)]
    bad = []
    for n in names:
        t = time.time()
        try:
            ok, note = compare(spark, con, n, catalog.QUERIES[n], catalog.ORACLES.get(n), folder)
        except Exception as e:
            ok, note = False, f"{type(e).__name__}: {str(e)[:1200]}"
        print(f"{'ok  ' if ok else 'FAIL'} {n} {time.time() - t:.1f}s {note}", flush=True)
        if not ok:
            bad.append(n)
    print(len(names) - len(bad), "ok;", "failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
