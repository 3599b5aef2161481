"""Runs queries next to their SQL and compares the rows.

    python -m checks.compare [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import tempfile
import time

import duckdb

from parapet.sources.tables import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')"
        )
    return connection


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if hasattr(value, "tzinfo"):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(
        (tuple(_plain(row[i]) for i in order) for row in rows), key=repr
    )


def compare(spark, connection, name, folder, queries, statements) -> tuple[bool, str]:
    start = time.time()
    frame = queries[name](spark, folder)
    ours = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    spent = time.time() - start
    if name not in statements:
        return True, f"rows={len(ours[1])} spark={spent:.1f}s (no SQL)"
    start = time.time()
    result = connection.execute(statements[name])
    theirs = rows_of([c[0] for c in result.description], result.fetchall())
    sql_spent = time.time() - start
    note = f"rows={len(ours[1])} spark={spent:.1f}s sql={sql_spent:.1f}s"
    if ours == theirs:
        return True, note
    if ours[0] != theirs[0]:
        return False, f"{note} columns {ours[0]} vs {theirs[0]}"
    first = next(
        ((a, b) for a, b in zip(ours[1], theirs[1]) if a != b),
        (len(ours[1]), len(theirs[1])),
    )
    differing = sum(a != b for a, b in zip(ours[1], theirs[1]))
    return False, f"{note} sql_rows={len(theirs[1])} differing={differing} first={str(first)[:600]}"


def main() -> None:
    from pyspark.sql import SparkSession

    from checks.catalog import QUERIES, SQL

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    chosen = parser.parse_args()
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="parapet-compare-"))
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(chosen.sf)
    failed = []
    for name in chosen.names or QUERIES:
        try:
            good, note = compare(spark, connection, name, chosen.sf, QUERIES, SQL)
        except Exception as error:  # report and go on with the next query
            good, note = False, f"{type(error).__name__}: {str(error)[:700]}"
        print("ok  " if good else "FAIL", name, note, flush=True)
        if not good:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
