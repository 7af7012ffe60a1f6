"""Compare registered queries with their oracle SQL: python oracle_check.py [--sf 0.01] [name-prefix ...]"""

from __future__ import annotations

import argparse
import math
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def normal(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def differences(spark_rows, duck_rows, names):
    """Exact comparison after sorting; the first few differing rows."""
    a, b = normal(spark_rows), normal(duck_rows)
    if len(a) != len(b):
        return [f"rows {len(a)} != {len(b)}", *a[:2], *b[:2]]
    bad, near = [], 0
    for x, y in zip(a, b):
        if x != y:
            close = all(p == q or (isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, abs_tol=1.1e-6)) for p, q in zip(x, y))
            near += close
            bad.append(f"{'~' if close else '!'} {dict((n, (p, q)) for n, p, q in zip(names, x, y) if p != q)}")
    return [f"{len(bad)} of {len(a)} rows differ ({near} by rounding)", *bad[:4]] if bad else []


def check(name, fn, sql, spark, con, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    names = sorted(df.columns)
    df = df.select(*[f"`{n}`" for n in names])
    rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    plan = df._jdf.queryExecution().executedPlan().toString()
    bad = [op for op in ("CartesianProduct", "BroadcastNestedLoopJoin") if op in plan]
    if bad:
        return len(rows), t1 - t0, 0.0, [f"plan has {bad}"]
    if sql is None:
        return len(rows), t1 - t0, 0.0, [] if rows else ["no rows"]
    rel = con.execute(sql)
    cols = [c[0] for c in rel.description]
    if sorted(cols) != names:
        return len(rows), t1 - t0, 0.0, [f"columns {names} != {sorted(cols)}"]
    order = [cols.index(n) for n in names]
    duck = [tuple(r[i] for i in order) for r in rel.fetchall()]
    return len(rows), t1 - t0, time.time() - t1, differences(rows, duck, names) or ([] if rows else ["no rows"])


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("prefix", nargs="*")
    args = ap.parse_args()
    from tokenfold import workload
    from tokenfold.session import local_session

    workload.load()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark, con = local_session(), connect(sf_dir)
    failed = []
    for name, fn in workload.QUERIES.items():
        if args.prefix and not any(name.startswith(p) for p in args.prefix):
            continue
        try:
            n, ts, td, diff = check(name, fn, workload.ORACLE.get(name), spark, con, sf_dir)
        except Exception as e:  # a broken query must not hide the next ones
            n, ts, td, diff = 0, 0.0, 0.0, [f"{type(e).__name__}: {str(e)[:700]}"]
        mark = "FAIL" if diff else ("ok" if name in workload.ORACLE else "rows-only")
        print(f"{mark:9s} {name:34s} rows={n:<8d} spark={ts:6.2f}s duck={td:5.2f}s", flush=True)
        for line in diff:
            print("    ", str(line)[:900])
        failed += [name] if diff else []
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
