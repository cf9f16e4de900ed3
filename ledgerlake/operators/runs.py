"""Builds and changes: decide on all scripts in one plan, run those that need it, and give back the ledger rows.

Scripts define tables and views, so they run one after another on the driver, as any DDL does. Everything around that
loop is a plan: hashing, change detection, the skip cascade, the roll-up and the combined checksum.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from datetime import datetime

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake import schemas
from ledgerlake.operators import corpus, ledger


@dataclass(frozen=True)
class Operation:
    """What is run, by whom, and for which configuration."""

    name: str
    config: str
    executed_by: str
    executed_at: datetime
    change_type: str = "build"
    direction: str = "change"
    cli_version: str = ""


@dataclass(frozen=True)
class Outcome:
    """New ledger rows of one operation, and its roll-up status: success, partial or failed."""

    operations: DataFrame
    executions: DataFrame
    status: str
    files_run: int
    files_skipped: int
    files_failed: int


def run_text(spark: SparkSession, text: str) -> None:
    """Run the statements of a script, separated by semicolons."""
    spark.sql(f"BEGIN\n{text.strip().rstrip(';')}\n;\nEND")


def _next_id(df: DataFrame) -> int:
    return (df.agg(F.max("id")).first()[0] or 0) + 1


def run_scripts(
    scripts: DataFrame, operation: Operation, operations: DataFrame, executions: DataFrame, abort_on_error: bool = True
) -> Outcome:
    """Run ``filepath, content, checksum, needs_run, skip_reason`` rows in path order as one operation.

    After a failure the remaining scripts are not run and count as skipped, unless ``abort_on_error`` is off.
    """
    spark = scripts.sparkSession
    operation_id, first_id = _next_id(operations), _next_id(executions)
    wanted = scripts.withColumn("content", F.when(F.col("needs_run"), F.col("content")))
    start = time.monotonic()
    rows, aborted, error_text = [], False, ""
    for number, script in enumerate(wanted.orderBy("filepath").toLocalIterator()):
        status, error, took = "pending", "", 0.0
        if not script.needs_run:
            status = "skipped"
        elif not aborted:
            begun = time.monotonic()
            try:
                run_text(spark, script.content)
                status = "success"
            except PySparkException as problem:
                status, error, aborted = "failed", str(problem), abort_on_error
                error_text = error_text or error
            took = (time.monotonic() - begun) * 1000
        rows.append(
            (
                first_id + number, operation_id, script.filepath, "sql", script.checksum, operation.cli_version, status, error,
                script.skip_reason or "", round(took),
            )
        )
    done = spark.createDataFrame(rows, schemas.EXECUTIONS)
    if abort_on_error:
        cascaded = ledger.abort_cascade(done.withColumnRenamed("skip_reason", "own_reason"), "change_id", "id")
        reason = F.when(F.col("skip_reason") == "", F.col("own_reason")).otherwise(F.col("skip_reason"))
        done = cascaded.withColumn("skip_reason", reason).select(*schemas.EXECUTIONS.names)
    total = ledger.batch_rollup(done, "change_id").first()
    checksum = ledger.combined_checksum(done, ["change_id"]).first()
    record = (
        operation_id, operation.name, operation.change_type, operation.direction, checksum.checksum if checksum else "",
        operation.executed_at, operation.executed_by, operation.config, operation.cli_version,
        total.stored_status if total else "success", error_text if aborted else "",
        round((time.monotonic() - start) * 1000),
    )
    counts = (total.files_run, total.files_skipped, total.files_failed) if total else (0, 0, 0)
    return Outcome(
        spark.createDataFrame([record], schemas.OPERATIONS), done, total.status if total else "success", *counts
    )


def preview(scripts: DataFrame, operations: DataFrame, executions: DataFrame, config: str, force: bool = False) -> DataFrame:
    """Scripts (``path, content``) with their checksum and whether a build would run them."""
    files = corpus.fingerprinted(scripts).withColumnRenamed("path", "filepath")
    return ledger.file_decisions(files, executions, operations, config, force)


def build(
    scripts: DataFrame,
    operation: Operation,
    operations: DataFrame,
    executions: DataFrame,
    force: bool = False,
    abort_on_error: bool = True,
) -> Outcome:
    """Run the scripts that are new, changed, failed or stale."""
    decided = preview(scripts, operations, executions, operation.config, force)
    return run_scripts(decided, operation, operations, executions, abort_on_error)


def apply_change(
    scripts: DataFrame, operation: Operation, operations: DataFrame, executions: DataFrame, force: bool = False
) -> Outcome | str:
    """Apply or revert one change (all of its scripts), or the reason why not."""
    spark = scripts.sparkSession
    files = corpus.fingerprinted(scripts).withColumnRenamed("path", "filepath")
    if operation.direction == "change":
        whole = ledger.combined_checksum(files.withColumn("name", F.lit(operation.name)), ["name"])
        decision = ledger.change_decisions(whole, operations, operation.config, force).first()
        refused = None if decision.needs_run else decision.skip_reason
    else:
        named = spark.createDataFrame([(operation.name,)], "name STRING")
        decision = ledger.revert_eligibility(named, operations, operation.config, force).first()
        refused = None if decision.can_revert else decision.reason
    if refused:
        return refused
    ready = files.withColumns({"needs_run": F.lit(True), "skip_reason": F.lit("")})
    return run_scripts(ready, operation, operations, executions)


def ledger_after(operations: DataFrame, executions: DataFrame, outcome: Outcome) -> tuple[DataFrame, DataFrame]:
    """Both ledgers with the outcome; a successful revert also marks the change it undid."""
    record = outcome.operations.first()
    if record.direction == "revert" and record.status == "success":
        operations = ledger.mark_reverted(operations, outcome.operations.select("name"), record.config_name)
    return operations.unionByName(outcome.operations), executions.unionByName(outcome.executions)
