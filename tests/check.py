"""Compare registered queries with their SQL twins: python -m tests.check [pattern] [sf_dir]."""

from __future__ import annotations

import math
import re
import sys
import time

import duckdb

from gridreach.plans.world import BASE

TEST_SF = "/root/testdata/sf0.01"


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return repr(v + 0.0)
    return str(v)


def kind(v):
    return "f" if isinstance(v, float) else "b" if isinstance(v, bool) else "i" if isinstance(v, int) else "s"


def compare(spark_df, con, sql):
    """None when equal, else a short description of the first difference."""
    rows = [tuple(r) for r in spark_df.collect()]
    cols = list(spark_df.columns)
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    if sorted(cols) != sorted(dcols):
        return f"columns {sorted(cols)} != {sorted(dcols)}"
    so, do = sorted(range(len(cols)), key=lambda i: cols[i]), sorted(range(len(dcols)), key=lambda i: dcols[i])
    if len(rows) != len(drows):
        return f"rows {len(rows)} != {len(drows)}"
    names = sorted(cols)
    for j, n in enumerate(names):
        a = {kind(r[so[j]]) for r in rows if r[so[j]] is not None}
        b = {kind(r[do[j]]) for r in drows if r[do[j]] is not None}
        if a and b and a != b:
            return f"type of {n}: {a} != {b}"
    left = sorted([tuple(norm(r[i]) for i in so) for r in rows], key=repr)
    right = sorted([tuple(norm(r[i]) for i in do) for r in drows], key=repr)
    bad = [(x, y) for x, y in zip(left, right) if x != y]
    if bad:
        return f"{len(bad)} of {len(left)} rows differ, columns {names}: spark {bad[0][0]} sql {bad[0][1]}"
    return None if rows else "EMPTY"


def main() -> int:
    from gridreach.plans import all_queries
    from gridreach.plans.world import World
    from gridreach.session import local_session, scratch_scope

    pattern, sf = (sys.argv[1] if len(sys.argv) > 1 else "."), (sys.argv[2] if len(sys.argv) > 2 else TEST_SF)
    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    con, failed, n = duck(sf), 0, 0
    for name, q in all_queries().items():
        if not re.search(pattern, name):
            continue
        n += 1
        t = time.time()
        try:
            with scratch_scope(spark):
                df = q.build(World(spark, sf))
                if q.sql is None:
                    msg = None if df.count() > 0 else "EMPTY"
                else:
                    msg = compare(df, con, q.oracle())
        except Exception as e:  # report and go on
            msg = f"{type(e).__name__}: {str(e)[:700]}"
        failed += msg is not None
        dt = time.time() - t
        if msg or dt > 8:
            print(f"{'FAIL' if msg else 'slow'} {name} {dt:.1f}s {msg or ''}", flush=True)
    print(f"{n - failed} of {n} ok")
    return failed


if __name__ == "__main__":
    sys.exit(min(main(), 1))
