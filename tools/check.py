"""Run registered queries and compare them with their SQL in DuckDB.

usage: python tools/check.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pairpref import catalog  # noqa: E402
from pairpref.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def normal(value):
    """Values with their kind, so that 4 and 4.0 differ as they would in a hash of printed values."""
    if isinstance(value, float) and math.isnan(value):
        return None
    return (type(value).__name__, value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(normal(row[i]) for i in order) for row in rows], key=repr)


def compare(spark, duck, name, sf_dir):
    start = time.time()
    frame = catalog.QUERIES[name](spark, sf_dir)
    mine = [tuple(row) for row in frame.collect()]
    spark_seconds = time.time() - start
    sql = catalog.EQUIVALENT_SQL.get(name)
    if sql is None:
        return f"rows only ({len(mine)})", spark_seconds, 0.0
    start = time.time()
    result = duck.execute(sql)
    columns = [c[0] for c in result.description]
    theirs = result.fetchall()
    duck_seconds = time.time() - start
    if sorted(columns) != sorted(frame.columns):
        return f"COLUMNS {sorted(frame.columns)} != {sorted(columns)}", spark_seconds, duck_seconds
    left, right = rows_of(frame.columns, mine), rows_of(columns, theirs)
    if left == right:
        return f"ok ({len(mine)})", spark_seconds, duck_seconds
    only = [r for r in left if r not in set(map(tuple, right))][:2], [r for r in right if r not in set(left)][:2]
    return f"DIFFERENT {len(left)} / {len(right)}: {str(only)[:900]}", spark_seconds, duck_seconds


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    options = parser.parse_args()
    sf_dir = f"/root/testdata/sf{options.sf}"
    catalog.load()
    spark = local_session(8)
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    bad = 0
    for name in catalog.QUERIES:
        if options.names and not any(name.startswith(prefix) for prefix in options.names):
            continue
        try:
            status, s, d = compare(spark, duck, name, sf_dir)
        except Exception as error:  # report and go on with the next query
            status, s, d = f"ERROR {type(error).__name__}: {str(error)[:700]}", 0.0, 0.0
        bad += not status.startswith(("ok", "rows"))
        print(f"{name:34s} spark {s:6.1f}s duckdb {d:6.1f}s  {status}", flush=True)
        if "INTERNAL" in status or "FATAL" in status:
            duck = duckdb.connect()
            for table in TABLES:
                duck.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    print(f"{bad} not in agreement")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
