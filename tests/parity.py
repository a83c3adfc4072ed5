"""Compare registered queries with their check SQL in DuckDB."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def norm(v):
    if v is None:
        return "\0null"
    if isinstance(v, bool):
        return f"b{int(v)}"
    if isinstance(v, int):
        return f"i{v}"
    if isinstance(v, float):
        if math.isnan(v):
            return "fnan"
        return f"f{v + 0.0!r}"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return f"s{v}"


def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(f)[:-8]
        con.execute(f"create view {name} as select * from '{f}'")
    return con


def compare(con, df, sql):
    """Return (ok, message)."""
    cols = sorted(df.columns)
    got = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return False, f"columns differ: {cols} vs {sorted(names)}"
    idx = [names.index(c) for c in cols]
    want = [tuple(norm(row[i]) for i in idx) for row in cur.fetchall()]
    got.sort()
    want.sort()
    if got == want:
        return True, f"{len(got)} rows"
    from collections import Counter
    g, w = Counter(got), Counter(want)
    a, b = list((g - w).items())[:3], list((w - g).items())[:3]
    return False, f"rows {len(got)} vs {len(want)}; cols {cols}\n   spark {a}\n   duck  {b}"


if __name__ == "__main__":
    from corvida.session import get_session
    import __spark_entry__ as entry
    sf = sys.argv[1]
    pats = sys.argv[2:]
    spark = get_session("local[4]", spark__sql__shuffle__partitions="8", spark__driver__memory="16g",
                        spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__sql__autoBroadcastJoinThreshold="10MB")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = []
    for n, fn in qs.items():
        if pats and not any(p in n for p in pats):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if n in sqls:
                ok, msg = compare(con, df, sqls[n])
            else:
                ok, msg = True, f"{df.count()} rows (no sql)"
        except Exception as e:
            ok, msg = False, str(e)[:1500] if "-v" not in pats else traceback.format_exc()
        if not ok:
            bad.append(n)
        print(f"{'OK ' if ok else 'BAD'} {n} {time.time() - t:.1f}s {msg}", flush=True)
    print("failed:", bad)
