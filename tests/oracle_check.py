"""Compare catalogue queries with their SQL counterparts on DuckDB.

Run as a script for a quick look:  python tests/oracle_check.py [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import sys
import time
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, float) and value.is_integer():
        return int(value)
    if isinstance(value, datetime):
        return value.date() if value.time() == value.time().min else value
    if isinstance(value, bool):
        return value
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(out, key=repr)


def compare(spark, con, entry, sf_dir):
    """Returns (row count, None) or (row count, a message saying what differs)."""
    from rollcall.catalog.entries import Star

    df = entry.run(Star(spark, sf_dir))
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(entry.sql)
    names = [c[0] for c in result.description]
    want = normal(names, result.fetchall())
    if got[0] != want[0]:
        return len(got[1]), f"columns differ: {set(got[0]) ^ set(want[0])}"
    if got[1] != want[1]:
        extra = [r for r in got[1] if r not in set(want[1])][:2]
        lost = [r for r in want[1] if r not in set(got[1])][:2]
        return len(got[1]), f"{len(got[1])} rows vs {len(want[1])}; spark only {extra}; sql only {lost}"
    return len(got[1]), None


def session():
    from pyspark.sql import SparkSession

    from rollcall.session import tune

    spark = (
        SparkSession.builder.master("local[8]")
        .appName("rollcall-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.default.parallelism", "2")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


if __name__ == "__main__":
    from rollcall.catalog import all_entries

    directory = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark, con, bad = session(), connect(directory), 0
    for item in all_entries():
        if prefixes and not item.name.startswith(prefixes):
            continue
        start = time.time()
        try:
            rows, problem = compare(spark, con, item, directory)
        except Exception as error:  # report and go on with the next query
            rows, problem = -1, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {item.name:45s} {rows:6d} rows {time.time() - start:5.1f}s {problem or ''}", flush=True)
    print(f"{bad} differ")
    spark.stop()
