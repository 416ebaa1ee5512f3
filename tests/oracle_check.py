"""Run registered Spark queries next to their DuckDB oracles and compare.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Compares column names and types, row counts and the order-insensitive
multiset of rows (doubles compared after rounding to 6 decimals).
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SPARK_TO_DUCK = {"IntegerType": "INTEGER", "LongType": "BIGINT", "DoubleType": "DOUBLE", "StringType": "VARCHAR",
                 "BooleanType": "BOOLEAN", "DateType": "DATE", "TimestampNTZType": "TIMESTAMP"}

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if hasattr(v, "item"):
        return _norm(v.item())
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _key(row):
    return tuple((x is None, str(type(x).__name__), x if x is not None else 0) for x in row)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=_key)


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def compare(spark, sf_dir: str, name: str, con=None) -> tuple[bool, str]:
    import __spark_entry__ as E
    con = con or duck(sf_dir)
    t0 = time.time()
    df = E.queries()[name](spark, sf_dir)
    s_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    sql = E.oracle_sql().get(name)
    if sql is None:
        return True, f"{name}: {len(s_rows)} rows (no oracle) spark {t1 - t0:.2f}s"
    d_types = {r[0]: r[1] for r in con.execute("DESCRIBE " + sql).fetchall()}
    s_types = {f.name: SPARK_TO_DUCK.get(type(f.dataType).__name__, str(f.dataType)) for f in df.schema.fields}
    if s_types != d_types:
        diff = {k: (s_types.get(k), d_types.get(k)) for k in set(s_types) | set(d_types)
                if s_types.get(k) != d_types.get(k)}
        return False, f"{name}: column types differ (spark, duck): {diff}"
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    s_cols, s_can = canonical(df.columns, s_rows)
    d_cols, d_can = canonical(d_cols, d_rows)
    if s_cols != d_cols:
        return False, f"{name}: columns differ spark={s_cols} duck={d_cols}"
    if len(s_can) != len(d_can):
        return False, f"{name}: rows differ spark={len(s_can)} duck={len(d_can)}"
    bad = [(a, b) for a, b in zip(s_can, d_can) if a != b]
    if bad:
        return False, f"{name}: {len(bad)} value mismatches, first spark={bad[0][0]} duck={bad[0][1]}"
    return True, f"{name}: OK {len(s_can)} rows spark {t1 - t0:.2f}s"


def main(argv):
    from stratus.plans.session import build_session
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as E
    spark = build_session()
    con = duck(sf_dir)
    names = names or list(E.queries())
    failed = 0
    for n in names:
        try:
            ok, msg = compare(spark, sf_dir, n, con)
        except Exception as e:  # report and continue
            ok, msg = False, f"{n}: ERROR {type(e).__name__}: {str(e)[:400]}"
        failed += not ok
        print(("PASS " if ok else "FAIL ") + msg, flush=True)
    print(f"{len(names) - failed}/{len(names)} passed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
