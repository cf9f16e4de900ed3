"""Live tail of a log folder."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ledgerlake.operators import eventlog
from ledgerlake.sources.growing import growing_lines

REFRESH = "2 seconds"


def tail_stream(spark: SparkSession, folder: str, level: str = "verbose", keys: Iterable[str] | None = None, **options: str) -> DataFrame:
    """New log lines as parsed, redacted entries at or above the level. Stateless: rows never shuffle.

    Files may grow and be rotated between the batches; ``options`` are those of the source of growing lines.
    """
    entries = eventlog.parse_lines(growing_lines(spark, folder, **options), "line")
    return eventlog.redact(eventlog.threshold(entries, level), keys)


def start_tail(entries: DataFrame, output: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append the entries to a parquet folder; ``once`` takes what is there and stops."""
    writer = entries.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=REFRESH)
    return writer.outputMode("append").start()
