"""Compare registered queries with their SQL on the same tables. Usable as a script."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value + 0.0)
    return value if value is None else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shown = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(shown, key=lambda r: tuple(x or "" for x in r))


def compare(spark, con, sf, query, sql) -> str:
    """Empty when equal, otherwise what differs."""
    df = query(spark, sf)
    got_columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    want_columns, want = rows_of([d[0] for d in result.description], result.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if not want:
        return "the SQL gives no rows"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)} rows"
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(wrong)} of {len(want)} rows differ, first {wrong[0]}" if wrong else ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tidegauge.runtime import build_session

    sf = f"/root/testdata/{sys.argv[1]}"
    spark = build_session(master="local[8]", **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                                     "spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles = connect(sf), entry.oracle_sql()
    for name, query in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, sf, query, oracles[name])
            else:
                problem = f"no SQL, {query(spark, sf).count()} rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        state = "ok  " if not problem else "rows" if problem.startswith("no SQL") else "DIFF"
        print(f"{state} {name} {time.time() - start:.1f}s {problem}", flush=True)
