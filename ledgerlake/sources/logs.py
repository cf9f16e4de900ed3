"""JSON-lines logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlake.operators import eventlog


def read_log(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Valid entries of a log file or folder; with a limit, only the newest."""
    lines = spark.read.text(path)
    return eventlog.parse_lines(lines) if limit is None else eventlog.tail(lines, limit)


def write_log(entries: DataFrame, path: str) -> None:
    """Append entries as JSON lines; fields that are null are left out."""
    entries.write.mode("append").json(path)
