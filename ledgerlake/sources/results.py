"""Raw SQL, its stored results and its history."""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlake import schemas
from ledgerlake.operators import eventlog
from ledgerlake.operators.ranking import estimated_bytes
from ledgerlake.sources.versions import VersionedTable

#: About as many bytes of input make one partition of a kept table; each costs a task a level.
KEPT_BYTES = 32 << 20


@dataclass(frozen=True)
class SqlResult:
    """Outcome of a statement that has run: the run's time, the rows it gives, and their number (a command: rows affected, where
    the table format says so)."""

    success: bool
    duration_ms: float
    rows: DataFrame | None = None
    error_message: str | None = None
    row_count: int | None = None

    @property
    def columns(self) -> list[str]:
        return self.rows.columns if self.rows is not None else []


def lift_recursion_limits(spark: SparkSession) -> None:
    """Recursive statements of the session may have any number of rows and levels."""
    for limit in ("spark.sql.cteRecursionLevelLimit", "spark.sql.cteRecursionRowLimit"):
        spark.conf.set(limit, -1)


def create_step_view(table: DataFrame, name: str, key: str | None = None) -> None:
    """A view of a table that every level of a recursive statement joins; joins with it are shuffled.

    Its estimate counts compressed bytes, so millions of short rows would be broadcast, through the driver, once a level. With ``key``, a
    column of that join, the table is kept dealt and sorted by it: a level then exchanges only the rows of the level before.
    """
    if key:
        spark, asked = table.sparkSession, math.ceil(estimated_bytes(table) / KEPT_BYTES)  # beyond any real size if not known
        parts = max(spark.sparkContext.defaultParallelism, min(asked, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        table = table.repartition(parts, key).sortWithinPartitions(key).persist()
    table.hint("merge").createOrReplaceTempView(name)


def run_sql(spark: SparkSession, text: str, args: dict[str, Any] | None = None) -> SqlResult:
    """Run SQL text as it is, with bound parameters; errors of planning and of the run become part of the result.

    A query is run to its end and counted; nothing is kept, so its rows, in their order, are computed again where they are used. To
    keep them, use :func:`record_sql`.
    """
    lift_recursion_limits(spark)
    start = time.monotonic()
    count = None
    try:
        rows = spark.sql(text, args=args or {})
        if "num_affected_rows" in rows.columns:
            count = rows.first()["num_affected_rows"]
        elif rows.columns:
            seen = Observation()
            rows.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
            count = seen.get["n"]
    except PySparkException as error:
        return SqlResult(False, (time.monotonic() - start) * 1000, error_message=str(error))
    return SqlResult(True, (time.monotonic() - start) * 1000, rows, row_count=count)


def save_result(df: DataFrame, folder: str, result_id: str) -> None:
    """Write a result as gzip JSON, by the executors, with its schema beside it."""
    df.write.option("compression", "gzip").option("ignoreNullFields", "false").json(f"{folder}/{result_id}/rows")
    schema = df.sparkSession.createDataFrame([(df.schema.json(),)], "value STRING")
    schema.coalesce(1).write.text(f"{folder}/{result_id}/schema")


def load_result(spark: SparkSession, folder: str, result_id: str) -> DataFrame:
    text = spark.read.text(f"{folder}/{result_id}/schema").first()["value"]
    schema = StructType.fromJson(json.loads(text))
    return spark.read.schema(schema).json(f"{folder}/{result_id}/rows")


def record_sql(
    spark: SparkSession, text: str, history: str, results: str, args: dict[str, Any] | None = None
) -> SqlResult:
    """Run SQL, store its rows, and append a history entry. Rows are counted while they are written.

    The history is a versioned table, which compacts itself; several sessions may write to it at once.
    """
    start = time.monotonic()
    executed_at = datetime.now(timezone.utc)
    result_id = str(uuid.uuid4())
    count, stored = None, None
    lift_recursion_limits(spark)
    try:
        rows = spark.sql(text, args=args or {})
        if rows.columns:
            seen = Observation(result_id)
            save_result(rows.observe(seen, F.count(F.lit(1)).alias("n")), results, result_id)
            count, stored = seen.get["n"], f"{results}/{result_id}"
            rows = load_result(spark, results, result_id)
        result = SqlResult(True, (time.monotonic() - start) * 1000, rows, row_count=count)
    except PySparkException as error:
        result = SqlResult(False, (time.monotonic() - start) * 1000, error_message=str(error))
    entry = (
        result_id, text, executed_at, result.duration_ms, result.success, result.error_message, count, stored,
    )
    VersionedTable(spark, history).append(spark.createDataFrame([entry], schemas.QUERY_HISTORY).coalesce(1))
    return result


def entries(spark: SparkSession, history: str) -> DataFrame:
    """All entries of a history; one without any gives no rows."""
    table = VersionedTable(spark, history)
    return table.read() if table.latest() else spark.createDataFrame([], schemas.QUERY_HISTORY)


def recent(spark: SparkSession, history: str, limit: int | None = None) -> DataFrame:
    """Entries newest first: all, or the first ``limit``."""
    rows = entries(spark, history).orderBy(F.col("executed_at").desc(), "id")
    return rows if limit is None else rows.limit(limit)


def prune(spark: SparkSession, history: str, as_of: Column, months: int) -> DataFrame:
    """Commit the history without entries older than some months; gives the entries left out, whose stored results can then be
    removed. Entries that others append meanwhile stay."""
    before = entries(spark, history)
    if VersionedTable(spark, history).latest():
        VersionedTable(spark, history).update(lambda rows: eventlog.retained(rows, as_of, months), "prune", tries=10)
    return eventlog.dropped(before, as_of, months)


def history_stats(spark: SparkSession, history: str, results: str) -> DataFrame:
    """Number of history entries and stored bytes; file sizes come from the listing, contents are not read."""
    counted = entries(spark, history).agg(F.count(F.lit(1)).alias("entry_count"))
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(results)
    )
    size = files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
    return counted.select("entry_count", size.scalar().alias("results_size"))
