"""Run registered queries in Spark and their SQL oracle in DuckDB; compare.

Mirrors the driver's gate: row count, column names, and an order-insensitive
multiset of rows (columns sorted by name).  Usage:
    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


SPARK2DUCK = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "smallint": "SMALLINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
    "array<string>": "VARCHAR[]",
}


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    rel = con.sql(sql)
    d_cols = list(rel.columns)
    d_types = dict(zip(d_cols, [str(t) for t in rel.types]))
    d_rows = rel.fetchall()
    t2 = time.time()
    problems = []
    s_types = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    bad_types = [
        (c, s_types[c], d_types.get(c)) for c in s_types if c in d_types and SPARK2DUCK.get(s_types[c]) != d_types[c]
    ]
    if bad_types:
        problems.append(f"types differ: {bad_types[:4]}")
    if sorted(s_cols) != sorted(d_cols):
        problems.append(f"columns differ: spark-only={sorted(set(s_cols)-set(d_cols))} oracle-only={sorted(set(d_cols)-set(s_cols))}")
    if len(s_rows) != len(d_rows):
        problems.append(f"rows {len(s_rows)} vs {len(d_rows)}")
    if not problems:
        order = sorted(s_cols)
        si = [s_cols.index(c) for c in order]
        di = [d_cols.index(c) for c in order]
        sc = Counter(tuple(norm(r[i]) for i in si) for r in s_rows)
        dc = Counter(tuple(norm(r[i]) for i in di) for r in d_rows)
        if sc != dc:
            only_s = list((sc - dc).elements())[:3]
            only_d = list((dc - sc).elements())[:3]
            # find differing columns
            bad = set()
            for a, b in zip(sorted(sc.elements(), key=repr), sorted(dc.elements(), key=repr)):
                for c, x, y in zip(order, a, b):
                    if x != y:
                        bad.add(c)
            problems.append(f"values differ in {sorted(bad)[:8]}; spark-only {only_s[:2]} oracle-only {only_d[:2]}")
    status = "OK" if not problems else "FAIL"
    print(f"{status:4} {name:34} rows={len(s_rows):6} spark={t1-t0:5.2f}s duck={t2-t1:5.2f}s {'; '.join(problems)}", flush=True)
    return not problems


def main():
    from tendril.registry import ORACLE, QUERIES
    from tendril.session import local_session

    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf_dir, args = args[0], args[1:]
    spark = local_session()
    con = duck(sf_dir)
    names = args or list(QUERIES)
    ok = 0
    for n in names:
        if n not in ORACLE:
            df = QUERIES[n](spark, sf_dir)
            print(f"NOSQL {n:33} rows={df.count():6}")
            continue
        try:
            ok += compare(spark, con, n, QUERIES[n], ORACLE[n], sf_dir)
        except Exception as e:  # report and go on
            print(f"ERR  {n:34} {type(e).__name__}: {str(e)[:300]}")
    print(f"{ok}/{sum(1 for n in names if n in ORACLE)} match")


if __name__ == "__main__":
    main()
