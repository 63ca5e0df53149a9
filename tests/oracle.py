"""Run registered queries next to their DuckDB SQL and compare the rows.

    python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import importlib
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    """Comparable form; the type is kept so that 1 and 1.0 differ."""
    if value is None:
        return "null"
    if isinstance(value, float):
        return "null" if math.isnan(value) else repr(value)
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{plain(v)}" for k, v in sorted(value.items())) + "}"
    return f"{type(value).__name__}:{value}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql) -> str | None:
    """None when equal, else what differs."""
    spark_rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    wanted = rows_of(columns, cursor.fetchall())
    if not wanted:
        return "the check has no rows"
    if spark_rows == wanted:
        return None
    if len(spark_rows) != len(wanted):
        return f"{len(spark_rows)} rows, expected {len(wanted)}"
    bad = [(a, b) for a, b in zip(spark_rows, wanted) if a != b]
    return f"{len(bad)} of {len(wanted)} rows differ, e.g.\n   {str(bad[0][0])[:600]}\n   {str(bad[0][1])[:600]}"


def main(argv) -> int:
    from textloom.plans.registry import ORACLES, QUERIES
    from textloom.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    importlib.import_module("textloom.plans")
    only = os.environ.get("PLANS")
    if only:
        wanted = only.split(",")
        names = [n for n, fn in QUERIES.items() if fn.__module__.rsplit(".", 1)[1] in wanted]
    spark = local_session()
    con = connect(sf_dir)
    failed = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLES:
                problem = compare(df, con, ORACLES[name])
            else:
                problem = None if df.count() > 0 else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        took = time.time() - start
        if problem:
            failed += 1
            print(f"FAIL {name} ({took:.1f}s): {problem}", flush=True)
        elif took > 4 or os.environ.get("VERBOSE"):
            print(f"ok   {name} ({took:.1f}s)", flush=True)
    print(f"{len(names or QUERIES) - failed} ok, {failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
