"""Compare registered queries with their SQL in DuckDB: ``python tests/oracle.py [folder] [name part …]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "∅"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


def _normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(spark, connection, query, folder: str) -> str | None:
    """None when both sides agree, else what differs."""
    frame = query(spark, folder)
    got = _normal(frame.columns, [tuple(row) for row in frame.collect()])
    result = connection.execute(query.sql)
    want = _normal([d[0] for d in result.description], result.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows != {len(want[1])}; only here {list(set(got[1]) - set(want[1]))[:2]}; only there {list(set(want[1]) - set(got[1]))[:2]}"
    for ours, theirs in zip(got[1], want[1]):
        if ours != theirs:
            return f"{ours} != {theirs}"
    return None if got[1] else "no rows"


def main() -> int:
    from ledgerlake.plans import all_queries
    from ledgerlake.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(partitions=8)
    spark.sparkContext.setLogLevel("OFF")
    connection = connect(folder)
    bad = 0
    for name, query in all_queries().items():
        if sys.argv[2:] and not any(part in name for part in sys.argv[2:]):
            continue
        start = time.monotonic()
        try:
            message = difference(spark, connection, query, folder) if query.sql else f"rows {query(spark, folder).count()}"
        except Exception as error:  # noqa: BLE001
            message = f"{type(error).__name__}: {error}"
        ok = message is None or not query.sql and message.startswith("rows")
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {time.monotonic() - start:.2f}s {'' if message is None else message[:700]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
