"""Run a query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]


def duck(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _plain(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    if isinstance(v, (int, decimal.Decimal)):
        return repr(float(v)) if isinstance(v, decimal.Decimal) else str(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in data)


def compare(spark_df, con, sql):
    got_cols, got = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    rel = con.execute(sql)
    want_cols, want = rows([d[0] for d in rel.description], rel.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}", len(got)
    if got != want:
        g, w = set(got) - set(want), set(want) - set(got)
        return f"rows {len(got)} vs {len(want)}; only Spark {sorted(g)[:2]}; only SQL {sorted(w)[:2]}"[:1500], len(got)
    return None, len(got)


def main(argv):
    """`python tests/oracle.py [sf] [key prefix ...]` prints one line per query."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sys.path.insert(0, root)
    import __spark_entry__ as entry
    from postmill.session import get_spark

    sf = f"/root/testdata/sf{argv[0] if argv else '0.01'}"
    spark = get_spark(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    queries, sqls = entry.queries(), entry.oracle_sql()
    failed = []
    for key, fn in queries.items():
        if argv[1:] and not any(key.startswith(p) for p in argv[1:]):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if key in sqls:
                problem, n = compare(df, con, sqls[key])
            else:
                problem, n = None, len(df.collect())
        except Exception as e:  # report and go on with the next query
            problem, n = f"{type(e).__name__}: {str(e)[:1200]}", -1
        state = "FAIL" if problem else ("ok" if key in sqls else "ok (rows only)")
        print(f"{state:6} {key} rows={n} {time.time() - t:.1f}s", problem or "", flush=True)
        if problem:
            failed.append(key)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main(sys.argv[1:])
