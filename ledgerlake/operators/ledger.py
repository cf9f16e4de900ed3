"""Run ledger: latest state, change detection, reconcile, rewind, roll-ups, history and ledger updates.

"Latest" is ``max_by`` over an increasing id: it combines per task before the shuffle, so a name with a third of all
records costs one row per task, and the shuffled struct holds only the fields that are asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ledgerlake.operators.guards import one_per_key
from ledgerlake.operators.ranking import range_count
from ledgerlake.operators.skew import join_aggregated

RESET_NAME = "__reset__"
#: Hashes of a text that is digested: 512 KB. A power of two.
PACKED = 8192


def _none(column: str) -> Column:
    """Readers map the stored ``''`` back to null."""
    return F.nullif(F.col(column), F.lit("")).alias(column)


def _changes(operations: DataFrame, config: str) -> DataFrame:
    return operations.where((F.col("change_type") == "change") & (F.col("config_name") == config))


# --- latest state ----------------------------------------------------------------------------------------------------


def latest_statuses(operations: DataFrame, config: str) -> DataFrame:
    """Per change name: its latest forward record and the time of its latest successful revert.

    Both come from one grouping of one scan; the reference order is the record id.
    """
    forward = F.when(F.col("direction") == "change", F.col("id"))
    undone = F.when((F.col("direction") == "revert") & (F.col("status") == "success"), F.col("id"))
    record = F.struct("status", "executed_at", "executed_by", "error_message")
    grouped = (
        _changes(operations, config)
        .groupBy("name")
        .agg(F.max_by(record, forward).alias("r"), F.max_by("executed_at", undone).alias("reverted_at"))
    )
    return grouped.where(F.col("r").isNotNull()).select(
        "name",
        F.col("r.status").alias("status"),
        F.col("r.executed_at").alias("applied_at"),
        F.col("r.executed_by").alias("applied_by"),
        "reverted_at",
        F.nullif(F.col("r.error_message"), F.lit("")).alias("error_message"),
    )


def latest_executions(
    executions: DataFrame, operations: DataFrame, config: str, before: int | None = None, strict: bool = False
) -> DataFrame:
    """Per file: its latest execution with the status of the operation it belongs to.

    Only operations older than ``before`` count, so the records of the operation being decided never do. Unless
    ``strict``, only executions that ran (success or failed) count.
    """
    parents = operations.where(F.col("config_name") == config)
    if before is not None:
        parents = parents.where(F.col("id") < before)
    parents = parents.select(F.col("id").alias("change_id"), F.col("status").alias("change_status"))
    ran = executions if strict else executions.where(F.col("status").isin("success", "failed"))
    joined = ran.select("id", "change_id", "filepath", "checksum", "status").join(parents, "change_id")
    record = F.struct("checksum", F.col("status").alias("exec_status"), "change_status")
    grouped = joined.groupBy("filepath").agg(F.max_by(record, "id").alias("r"))
    return grouped.select("filepath", "r.*")


# --- change detection ------------------------------------------------------------------------------------------------


def file_decisions(
    files: DataFrame,
    executions: DataFrame,
    operations: DataFrame,
    config: str,
    force: bool = False,
    before: int | None = None,
    strict: bool = False,
) -> DataFrame:
    """Which files (``filepath``, ``checksum``) need to run, and why; all files in one join."""
    if force:
        none = F.lit(None).cast("string")
        return files.select(
            *files.columns, F.lit(True).alias("needs_run"), F.lit("force").alias("reason"), none.alias("skip_reason"), none.alias("previous_checksum")
        )
    latest = latest_executions(executions, operations, config, before, strict)
    latest = latest.withColumnRenamed("checksum", "previous_checksum")
    status = F.col("exec_status")
    reason = (
        F.when(status.isNull(), "new")
        .when(status == "failed", "failed")
        .when(status.isin("pending", "skipped"), "new")
        .when(F.col("change_status") == "stale", "stale")
        .when(~F.col("previous_checksum").eqNullSafe(F.col("checksum")), "changed")
    )
    decided = files.join(latest, "filepath", "left").withColumn("reason", reason)
    return decided.select(
        *files.columns,
        F.col("reason").isNotNull().alias("needs_run"),
        "reason",
        F.when(F.col("reason").isNull(), "unchanged").alias("skip_reason"),
        F.when(F.col("reason").isin("failed", "stale", "changed") | F.col("reason").isNull(), F.col("previous_checksum"))
        .alias("previous_checksum"),
    )


def change_decisions(
    changes: DataFrame, operations: DataFrame, config: str, force: bool = False, any_type: bool = False
) -> DataFrame:
    """Which changes (``name``, ``checksum``) need to run, and why.

    ``any_type`` looks at forward records of every operation type; there a reverted one counts as stale.
    """
    scope = operations.where(F.col("config_name") == config) if any_type else _changes(operations, config)
    latest = (
        scope.where(F.col("direction") == "change")
        .groupBy("name")
        .agg(F.max_by(F.struct("status", "checksum"), "id").alias("r"))
        .select("name", F.col("r.status").alias("previous_status"), F.col("r.checksum").alias("previous_checksum"))
    )
    status = F.col("previous_status")
    reason = (
        F.when(F.lit(force), "force")
        .when(status.isNull(), "new")
        .when(status == "failed", "failed")
        .when(status == "reverted", "stale" if any_type else "reverted")
        .when(status == "stale", "stale")
        .when(~F.col("previous_checksum").eqNullSafe(F.col("checksum")), "changed")
    )
    return changes.join(latest, "name", "left").select(
        *changes.columns,
        reason.isNotNull().alias("needs_run"),
        reason.alias("reason"),
        F.when(reason.isNull(), "already-run" if any_type else "already applied").alias("skip_reason"),
        *[F.when(F.lit(not force), F.col(c)).alias(c) for c in ("previous_checksum", "previous_status")],
    )


def revert_eligibility(names: DataFrame, operations: DataFrame, config: str, force: bool = False) -> DataFrame:
    """Which of the named changes may be reverted, and why not."""
    statuses = latest_statuses(operations, config).select("name", "status")
    status = F.col("status")
    allowed = F.when(status.isNull(), False).when(F.lit(force), True).otherwise(status.isin("success", "failed"))
    why = (
        F.when(status.isNull(), "not applied")
        .when(F.lit(force), None)
        .when(status == "pending", "not applied yet")
        .when(status == "reverted", "already reverted")
        .when(status == "stale", "schema was torn down")
        .when(~status.isin("success", "failed"), "unknown status")
    )
    return names.join(statuses, "name", "left").select(
        *names.columns, allowed.alias("can_revert"), why.alias("reason"), "status"
    )


# --- reconcile, next, rewind -----------------------------------------------------------------------------------------


def reconcile(disk: DataFrame, statuses: DataFrame) -> DataFrame:
    """Changes on disk and in the ledger in one list: new, known and orphaned."""
    on_disk = disk.withColumn("__disk", F.lit(True))
    known = statuses.withColumn("__known", F.lit(True))
    return on_disk.join(known, "name", "full_outer").select(
        *disk.columns,
        F.coalesce("status", F.lit("pending")).alias("status"),
        "applied_at",
        "applied_by",
        "reverted_at",
        "error_message",
        F.col("__known").isNull().alias("is_new"),
        F.col("__disk").isNull().alias("orphaned"),
    )


def orphans(statuses: DataFrame, disk: DataFrame) -> DataFrame:
    return statuses.join(disk.select("name"), "name", "left_anti").select("name")


def pending(reconciled: DataFrame) -> DataFrame:
    """Changes to run: pending or reverted, and on disk."""
    return reconciled.where(~F.col("orphaned") & F.col("status").isin("pending", "reverted"))


def next_changes(reconciled: DataFrame, count: int = 1) -> DataFrame:
    return pending(reconciled).orderBy("name").limit(count)


def fast_forward(reconciled: DataFrame) -> DataFrame:
    return pending(reconciled).orderBy("name")


def rewind_set(reconciled: DataFrame, target: int | str) -> DataFrame:
    """Applied changes to revert, newest first: the first ``target``, or all down to and including the named one.

    An unknown name gives no rows; see :func:`require_target`.
    """
    applied = reconciled.where(
        ~F.col("orphaned") & (F.col("status") == "success") & F.col("applied_at").isNotNull()
    )
    newest = [F.col("applied_at").desc(), F.col("name").asc()]
    if isinstance(target, int):
        return applied.orderBy(*newest).limit(target)
    reached = applied.where(F.col("name") == target).agg(F.max("applied_at").alias("t")).scalar()
    later = (F.col("applied_at") > reached) | ((F.col("applied_at") == reached) & (F.col("name") <= target))
    return applied.where(later).orderBy(*newest)


def require_target(reconciled: DataFrame, target: str) -> None:
    if rewind_set(reconciled, target).isEmpty():
        raise LookupError(f"no applied change named {target}")


# --- batches ---------------------------------------------------------------------------------------------------------


def abort_cascade(files: DataFrame, batch: str = "batch", seq: str = "seq") -> DataFrame:
    """Statuses of a batch that stops at its first failure: every later file is skipped.

    The first failure is a minimum per batch, not a running window, so no task has to sort a whole batch.
    """
    failed = F.when(F.col("status") == "failed", F.col(seq))
    first = (
        files.where(F.col("status") == "failed")
        .groupBy(batch)
        .agg(F.min(failed).alias("__stop"), F.min_by("filepath", failed).alias("__by"))
    )
    stopped = F.coalesce(F.col(seq) > F.col("__stop"), F.lit(False))
    return join_aggregated(files, first, [batch]).select(
        *[F.when(stopped, "skipped").otherwise(F.col(c)).alias(c) if c == "status" else F.col(c) for c in files.columns],
        F.when(stopped, F.concat(F.lit("Skipped due to failure in "), F.col("__by"))).otherwise("").alias("skip_reason"),
    )


def batch_rollup(files: DataFrame, batch: str = "batch") -> DataFrame:
    """Counts and status of each batch; the stored status folds partial into failed."""
    counts = files.groupBy(batch).agg(
        F.count_if(F.col("status") == "success").alias("files_run"),
        F.count_if(F.col("status") == "skipped").alias("files_skipped"),
        F.count_if(F.col("status") == "failed").alias("files_failed"),
    )
    bad = F.col("files_failed") > 0
    return counts.withColumns(
        {
            "status": F.when(bad & (F.col("files_run") > 0), "partial").when(bad, "failed").otherwise("success"),
            "stored_status": F.when(bad, "failed").otherwise("success"),
        }
    )


def with_category(decisions: DataFrame) -> DataFrame:
    """Category of a decided file: new, previously-run, changed or failed; all other reasons fall into new."""
    return decisions.select(
        "*",
        F.when(~F.col("needs_run"), "previously-run")
        .when(F.col("reason").isin("changed", "failed"), F.col("reason"))
        .otherwise("new")
        .alias("category"),
        (~F.col("needs_run")).alias("would_skip"),
    )


def file_status_summary(decisions: DataFrame) -> DataFrame:
    return (
        with_category(decisions)
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("files"), F.count_if("would_skip").alias("would_skip"))
    )


def combined_checksum(members: DataFrame, keys: Sequence[str], checksum: str = "checksum") -> DataFrame:
    """Fingerprint of each group: SHA-256 over its sorted member hashes, joined without separator; nulls are left out.

    Every group, of any size and with any nulls in its keys, goes one way: ranges of (key, hash) are sorted by as many tasks as the
    hashes ask for and joined to texts of at most ``PACKED`` hashes. SHA-256 is sequential, so one task digests a group; it reads those
    texts in order, as a stream, and sorts no hash.
    """
    rows = members.select(*keys, F.col(checksum).alias("__h"))
    ordered = rows.repartitionByRange(range_count(rows), *keys, "__h").sortWithinPartitions(*keys, "__h")
    blocks = ordered.withColumn("__block", F.shiftright(F.monotonically_increasing_id(), PACKED.bit_length() - 1))
    packed = blocks.groupBy(*keys, "__block").agg(F.array_join(F.sort_array(F.collect_list("__h")), "").alias("__h"))
    stream = packed.repartition(*keys).sortWithinPartitions(*keys, "__block").select(*keys, "__h")
    schema = members.select(*keys, F.lit("").alias("checksum")).schema
    return stream.mapInArrow(_stream_hash(len(keys), schema), schema)


def _stream_hash(width: int, schema: StructType):
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest, done = None, None, []

        def full() -> pa.RecordBatch:
            rows = [pa.array(c, f.type) for c, f in zip(zip(*done), kinds)]
            done.clear()
            return pa.RecordBatch.from_arrays(rows, schema=kinds)

        for batch in batches:
            *key_columns, hashes = (column.to_pylist() for column in batch.columns)
            for key, value in zip(zip(*key_columns) if width else [()] * len(hashes), hashes):
                if digest is None or key != current:
                    if digest is not None:
                        done.append((*current, digest.hexdigest()))
                    current, digest = key, hashlib.sha256()
                    if len(done) >= 10_000:
                        yield full()
                if value is not None:
                    digest.update(value.encode())
        if digest is not None:
            done.append((*current, digest.hexdigest()))
        if done:
            yield full()

    return run


# --- history ---------------------------------------------------------------------------------------------------------


def history(
    operations: DataFrame,
    config: str,
    name: str | None = None,
    types: Sequence[str] = ("change",),
    limit: int | None = None,
) -> DataFrame:
    """Operations newest first; ``types=()`` takes every operation type."""
    rows = operations.where(F.col("config_name") == config)
    if types:
        rows = rows.where(F.col("change_type").isin(list(types)))
    if name:
        rows = rows.where(F.col("name") == name)
    rows = rows.select(
        "id", "name", "change_type", "direction", "status", "executed_at", "executed_by", "duration_ms",
        _none("error_message"), "checksum",
    ).orderBy(F.col("id").desc())
    return rows.limit(limit) if limit else rows


def files_of(executions: DataFrame, operation_id: int) -> DataFrame:
    return (
        executions.where(F.col("change_id") == operation_id)
        .select(
            "id", "change_id", "filepath", "file_type", "checksum", "status", _none("skip_reason"),
            _none("error_message"), "duration_ms",
        )
        .orderBy("id")
    )


def latest_version(versions: DataFrame) -> DataFrame:
    return versions.orderBy(F.col("id").desc()).limit(1)


def expired_leases(leases: DataFrame, as_of: Column) -> DataFrame:
    return leases.where(F.col("expires_at") < as_of)


# --- ledger updates: each returns a new snapshot ---------------------------------------------------------------------


def _with_status(operations: DataFrame, test: Column, status: str) -> DataFrame:
    changed = F.when(F.coalesce(test, F.lit(False)), F.lit(status)).otherwise(F.col("status"))
    return operations.select(*[changed.alias(c) if c == "status" else F.col(c) for c in operations.columns])


def _stale_test(config: str) -> Column:
    return (
        (F.col("direction") == "change")
        & F.col("status").isin("success", "failed", "pending")
        & (F.col("config_name") == config)
    )


def mark_all_stale(operations: DataFrame, config: str) -> DataFrame:
    return _with_status(operations, _stale_test(config), "stale")


def count_to_mark_stale(operations: DataFrame, config: str) -> DataFrame:
    return operations.agg(F.count_if(_stale_test(config)).alias("marked"))


def mark_reverted(operations: DataFrame, names: DataFrame, config: str) -> DataFrame:
    """Set the latest forward record of each named change to reverted.

    Records are grouped before the join, so a name with a third of them costs one row per task.
    """
    latest = _changes(operations, config).where(F.col("direction") == "change").groupBy("name").agg(F.max("id").alias("id"))
    latest = latest.join(names.select("name").distinct(), "name", "left_semi").select("id", F.lit(True).alias("__hit"))
    joined = operations.join(latest, "id", "left")
    return _with_status(joined, F.col("__hit"), "reverted").select(*operations.columns)


def finalize(operations: DataFrame, closings: DataFrame, error_limit: int | None = None) -> DataFrame:
    """Close operations (``id, status, checksum, duration_ms, error_message``). A second closing of an id is an error.

    The error text is kept whole, or cut to ``error_limit`` characters.
    """
    error = F.coalesce("error_message", F.lit(""))
    fields = ("id", "status", "checksum", "duration_ms", "error_message")
    new = one_per_key(closings.select(*fields), ["id"]).select(
        "id",
        F.lit(True).alias("__hit"),
        F.col("status").alias("__status"),
        F.coalesce("checksum", F.lit("")).alias("__checksum"),
        F.floor(F.col("duration_ms") + 0.5).alias("__duration_ms"),
        (error if error_limit is None else F.substring(error, 1, error_limit)).alias("__error_message"),
    )
    return operations.join(new, "id", "left").select(
        *[
            F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in fields[1:] else F.col(c)
            for c in operations.columns
        ]
    )


def unmatched_closings(operations: DataFrame, closings: DataFrame) -> DataFrame:
    """Closings that name no operation, each with its error."""
    missing = closings.join(operations.select("id"), "id", "left_anti")
    return missing.select(
        "id", F.concat(F.lit("No operation record found with id "), F.col("id").cast("string")).alias("error")
    )


def purge(operations: DataFrame, executions: DataFrame, name: str, config: str) -> tuple[DataFrame, DataFrame]:
    """Both ledgers without one change's records."""
    own = (
        (F.col("name") == name) & (F.col("change_type") == "change") & (F.col("config_name") == config)
    )
    gone = operations.where(own).select(F.col("id").alias("change_id"))
    kept = operations.where(~F.coalesce(own, F.lit(False)))
    return kept, executions.join(gone, "change_id", "left_anti").select(*executions.columns)


def reset_record(operations: DataFrame, config: str, executed_by: str, reason: str, as_of: Column) -> DataFrame:
    """One ledger row that documents a teardown, with the next free id."""
    values = {
        "id": F.coalesce(F.max("id"), F.lit(0)) + 1, "name": F.lit(RESET_NAME), "change_type": F.lit("change"),
        "direction": F.lit("change"), "checksum": F.lit(""), "executed_at": as_of, "executed_by": F.lit(executed_by),
        "config_name": F.lit(config), "cli_version": F.lit(""), "status": F.lit("success"),
        "error_message": F.lit(reason), "duration_ms": F.lit(0),
    }
    return operations.agg(
        *[values[f.name].cast(f.dataType).alias(f.name) for f in operations.schema.fields if f.name in values]
    )
