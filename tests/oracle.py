"""Run a registered query in Spark and its oracle SQL in DuckDB, compare.

Mirrors the driver's check: same row count, same column names, same
multiset of rows (order-insensitive).
"""

from __future__ import annotations

import math
import os
import sys

import duckdb

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if REPO not in sys.path:
    sys.path.insert(0, REPO)

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, name: str, sf_dir: str, con=None) -> dict:
    import __spark_entry__ as E

    df = E.queries()[name](spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    result = {"name": name, "spark_rows": len(s_rows)}
    sql = E.oracle_sql().get(name)
    if sql is None:
        result["oracle"] = None
        return result
    con = con or duck(sf_dir)
    rel = con.execute(sql)
    d_cols = [c[0] for c in rel.description]
    d_rows = rel.fetchall()
    result["oracle_rows"] = len(d_rows)
    result["columns_match"] = sorted(s_cols) == sorted(d_cols)
    result["values_match"] = result["columns_match"] and _rows(s_cols, s_rows) == _rows(d_cols, d_rows)
    if not result["values_match"]:
        a, b = set(_rows(s_cols, s_rows)), set(_rows(d_cols, d_rows))
        result["spark_only"] = sorted(a - b, key=repr)[:3]
        result["oracle_only"] = sorted(b - a, key=repr)[:3]
        result["spark_cols"], result["oracle_cols"] = s_cols, d_cols
    return result


if __name__ == "__main__":
    import time

    from markhive.session import local_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    import __spark_entry__ as E

    names = sys.argv[1:] or list(E.queries())
    con = duck(sf)
    bad = 0
    for n in names:
        t = time.time()
        try:
            r = compare(spark, n, sf, con)
        except Exception as e:  # report and go on
            r = {"name": n, "error": repr(e)[:800]}
        r["sec"] = round(time.time() - t, 2)
        ok = r.get("values_match") or (r.get("oracle") is None and "error" not in r)
        bad += not ok
        print(("OK  " if ok else "BAD ") + str(r), flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
