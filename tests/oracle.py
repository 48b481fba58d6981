"""Run registered queries next to their SQL and compare rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, _plain(x)) for k, x in sorted(v.items()))
    if hasattr(v, "asDict"):
        return _plain(v.asDict())
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, fn, sql, sf_dir):
    t = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    spent = time.time() - t
    t = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    sql_spent = time.time() - t
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}", spent, sql_spent
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return True, f"{len(a)} rows", spent, sql_spent
    extra = [r for r in a if r not in set(b)][:3]
    lost = [r for r in b if r not in set(a)][:3]
    return False, f"spark {len(a)} sql {len(b)}\n    only spark {extra}\n    only sql {lost}", spent, sql_spent


if __name__ == "__main__":
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sys.path.insert(0, root)
    import __spark_entry__ as entry
    from tidemark.session import local_session

    sf = "/root/testdata/sf" + os.environ.get("SF", "0.01")
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in sys.argv[1:] or queries:
        try:
            if name not in sql:
                t = time.time()
                n = len(queries[name](spark, sf).collect())
                print(f"rows {name}: {n} rows {time.time()-t:.1f}s", flush=True)
                continue
            ok, note, a, b = compare(spark, con, queries[name], sql[name], sf)
            print(("ok  " if ok else "BAD ") + f"{name}: {note} spark {a:.1f}s sql {b:.1f}s", flush=True)
        except Exception as e:
            print(f"ERR {name}: {type(e).__name__} {str(e)[:600]}", flush=True)
