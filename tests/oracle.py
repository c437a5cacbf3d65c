"""Compare registered queries with their SQL twins in DuckDB.

Run as a script for a report: ``python -m tests.oracle [sf] [query ...]``.
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TESTDATA = os.environ.get("RUNLENS_TESTDATA", "/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return v
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def sorted_rows(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in at) for r in rows]
    return [columns[i] for i in at], sorted(plain, key=lambda r: tuple((x is None, str(type(x)), x) for x in r))


def difference(spark_df, con, sql: str) -> str | None:
    """None when both sides hold the same rows, else the first thing that differs."""
    cols, rows = sorted_rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    rel = con.execute(sql)
    dcols, drows = sorted_rows([d[0] for d in rel.description], rel.fetchall())
    if cols != dcols:
        return f"columns {cols} != {dcols}"
    if len(rows) != len(drows):
        return f"{len(rows)} rows != {len(drows)}"
    for a, b in zip(rows, drows):
        if a != b:
            return f"spark {a}\nduck  {b}"
    return None


def main(argv: list[str]) -> int:
    from tests.session import test_session
    from workload import ORACLES, QUERIES

    sf = argv[0] if argv else "0.01"
    sf_dir = f"{TESTDATA}/sf{sf}"
    spark = test_session()
    con = connect(sf_dir)
    bad = 0
    for name in argv[1:] or QUERIES:
        start = time.time()
        try:
            if name in ORACLES:
                found = difference(QUERIES[name](spark, sf_dir), con, ORACLES[name])
            else:
                found = None if QUERIES[name](spark, sf_dir).count() else "no rows"
        except Exception as e:  # report and go on with the next query
            found = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += found is not None
        mark = "ok  " if found is None else "FAIL"
        print(f"{mark} {name} {time.time() - start:.2f}s {'' if name in ORACLES else '(rows)'}", flush=True)
        if found:
            print(found, flush=True)
    print(f"{bad} failed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
