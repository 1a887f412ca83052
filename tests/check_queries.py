"""Compare registered queries with their SQL at one scale: python tests/check_queries.py [name ...]"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def canon(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "~nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return str(v)


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in data)


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, name, query, sql, sf_dir):
    t0 = time.time()
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return f"ROWS  {name} {len(got)} rows {t1 - t0:.2f}s"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"FAIL  {name} columns {sorted(df.columns)} vs {sorted(cols)}"
    a, b = rows(df.columns, got), rows(cols, want)
    if a == b:
        flag = "ok   " if a else "EMPTY"
        return f"{flag} {name} {len(a)} rows spark {t1 - t0:.2f}s duck {time.time() - t1:.2f}s"
    only_a = [r for r in a if r not in set(b)][:2]
    only_b = [r for r in b if r not in set(a)][:2]
    return f"FAIL  {name} {len(a)} vs {len(b)} {sorted(cols)}\n   spark {only_a}\n   sql   {only_b}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tests.conftest import make_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
    spark = make_session()
    con = connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    for name in sys.argv[1:] or queries:
        try:
            print(compare(spark, con, name, queries[name], sqls.get(name), sf_dir), flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"ERROR {name} {type(e).__name__} {str(e)[:600]}", flush=True)
    spark.stop()
