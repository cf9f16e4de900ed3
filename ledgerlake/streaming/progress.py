"""Run progress kept up to date from a stream of run events.

The state is one row per open run. A run leaves it some time after it finished, or when it was silent for long; both are told by event
time. What a batch changed is appended to a versioned table; nothing that did not change is written again.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ledgerlake.sources.versions import VersionedTable

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
COUNTERS = ["files_run", "files_skipped", "files_failed", "files_dry_run"]
#: Values of the newest event that has them, each with that event's ``seq``.
LATEST = ["files_total", "phase", "status", "current_file"]
STATE = (
    "first long, changes long, files_run long, files_skipped long, files_failed long, files_dry_run long, files_total int, files_total_at long, "
    "phase string, phase_at long, status string, status_at long, current_file string, current_file_at long"
)
FIELDS = [field.split(" ")[0] for field in STATE.split(", ")]


class RunProgress(StatefulProcessor):
    """Counters of a run, emitted after each batch that has events of it, and a last time when the run is closed."""

    def __init__(self, grace_ms: int, silence_ms: int):
        self.grace_ms = grace_ms
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("progress", STATE)
        self.last = handle.getValueState("last", "time long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = dict(zip(FIELDS, self.state.get())) if self.state.exists() else dict.fromkeys(FIELDS) | dict.fromkeys(COUNTERS, 0) | {"changes": 0}
        last = self.last.get()[0] if self.last.exists() else 0
        for row in rows:
            now["first"] = row.seq if now["first"] is None else now["first"]
            last = max(last, row.time_ms)
            _count(now, row)
        now["changes"] += 1
        self.state.update(tuple(now[f] for f in FIELDS))
        self.last.update((last,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + (self.grace_ms if now["phase"] == "complete" else self.silence_ms))
        yield self._row(key, now, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = dict(zip(FIELDS, self.state.get()))
        now["changes"] += 1
        self.state.clear()
        self.last.clear()
        yield self._row(key, now, True)

    def _row(self, key, now: dict, closed: bool) -> Row:
        return Row(**dict(zip(["run"], key)), **now, closed=closed)

    def close(self) -> None:
        pass


def _count(now: dict, row: Row) -> None:
    """One event. ``seq`` orders the events of a run, in whichever order they come."""
    good = row.status == "success"
    if row.type == "file:after" and good:
        now["files_run"] += 1
    elif row.type == "file:skip":
        now["files_skipped"] += 1
    elif row.type == "file:dry-run" and good:
        now["files_dry_run"] += 1
    elif row.type in ("file:after", "file:dry-run"):
        now["files_failed"] += 1

    def newer(name: str, value) -> None:
        if now[f"{name}_at"] is None or row.seq >= now[f"{name}_at"]:
            now[name], now[f"{name}_at"] = value, row.seq

    if row.type in ("build:start", "build:complete"):
        newer("phase", "running" if row.type == "build:start" else "complete")
    if row.type == "build:start":
        newer("files_total", row.file_count)
    if row.type == "build:complete":
        newer("status", row.status)
    if row.type in ("file:before", "file:after", "file:dry-run", "build:start", "build:complete"):
        newer("current_file", row.filepath if row.type == "file:before" else None)


def progress_stream(
    log: DataFrame, run: str = "run_id", time: str = "time", delay: str = "10 minutes", grace_minutes: int = 10, silence_minutes: int = 24 * 60
) -> DataFrame:
    """Changes of the runs of a stream of events (``run_id, seq, type, status, filepath, file_count, time``).

    Events may come late by ``delay``; later ones are left out. A finished run is closed ``grace_minutes`` after its last event, a
    silent one after ``silence_minutes``; both count event time. A run that goes on after that starts anew: its ``first`` tells its parts apart.
    """
    # workers get the processor with the plan and need not have the package installed
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    events = log.select(
        F.col(run).alias("run"), F.col("seq").cast("long").alias("seq"), "type", "status", "filepath", F.col("file_count").cast("int").alias("file_count"),
        F.col(time).cast("timestamp").alias("time"), F.unix_millis(F.col(time).cast("timestamp")).alias("time_ms"),
    )
    kind = log.schema[run].dataType.simpleString()
    processor = RunProgress(grace_minutes * 60_000, silence_minutes * 60_000)
    changes = events.withWatermark("time", delay).groupBy("run").transformWithState(processor, f"run {kind}, {STATE}, closed boolean", "Append", "EventTime")
    return changes.withColumnRenamed("run", run)


def start_progress(changes: DataFrame, output: str, checkpoint: str, run: str = "run_id", once: bool = False, most_folders: int = 32) -> StreamingQuery:
    """Append each batch's changes to a versioned table, once however often a batch is run.

    When it has more than ``most_folders`` folders, it is rewritten with only the newest change of each part of a run.
    """
    spark = changes.sparkSession
    table = VersionedTable(spark, output, most_folders=sys.maxsize)

    def write(batch: DataFrame, batch_id: int) -> None:
        made = table.append(batch, writer=checkpoint, batch=batch_id)
        if len(made.folders) > most_folders:
            table.compact(lambda rows: newest_changes(rows, run))

    writer = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)  # a query keeps the settings it was started with
    try:
        return writer.start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def newest_changes(changes: DataFrame, run: str = "run_id") -> DataFrame:
    """The newest change of each part of a run."""
    rest = [c for c in changes.columns if c not in (run, "first")]
    newest = changes.groupBy(run, "first").agg(F.max_by(F.struct(*rest), "changes").alias("row"))
    return newest.select(*[F.col(c) if c in (run, "first") else F.col(f"row.{c}").alias(c) for c in changes.columns])


def current_progress(spark: SparkSession, output: str, run: str = "run_id") -> DataFrame:
    """One row per run as :func:`ledgerlake.operators.eventlog.run_progress` gives it, from all parts of the run."""
    parts = newest_changes(VersionedTable(spark, output).read(), run)
    latest = [F.max_by(c, f"{c}_at").alias(c) for c in LATEST]
    runs = parts.groupBy(run).agg(*[F.sum(c).alias(c) for c in COUNTERS], *latest)
    return runs.withColumn("phase", F.coalesce("phase", F.lit("idle")))
