"""Run registered queries and their check SQL side by side: compare.py [sf dir] [name prefixes...]."""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def normal(v):
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def compare(spark, con, sf, name, fn, sql):
    start = time.time()
    df = fn(spark, sf)
    got = rows_of(df.columns, df.collect())
    took = time.time() - start
    if sql is None:
        return f"rows {len(got)}", took, True
    rel = con.execute(sql)
    columns = [c[0] for c in rel.description]
    want = rows_of(columns, rel.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}", took, False
    if got == want:
        return f"equal {len(got)}", took, True
    g, w = set(got), set(want)
    return f"DIFF {len(got)} != {len(want)}\n   only spark {sorted(g - w)[:3]}\n   only sql   {sorted(w - g)[:3]}", took, False


def main():
    from palisade.session import build_session
    from palisade import catalogue

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.001"
    spark = build_session("local[8]", "compare", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    queries, oracles = catalogue.queries(), catalogue.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if args and not any(name.startswith(a) for a in args):
            continue
        try:
            text, took, ok = compare(spark, con, sf, name, fn, oracles.get(name))
        except Exception as exc:
            text, took, ok = f"ERROR {type(exc).__name__}: {str(exc)[:700]}", 0.0, False
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {took:.1f}s {text}", flush=True)
    print(f"{bad} bad of {len(queries)}")


if __name__ == "__main__":
    main()
