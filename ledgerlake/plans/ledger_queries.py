"""Ledger states, change detection, reconcile, roll-ups, history and ledger updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.operators import ledger
from ledgerlake.plans import roles
from ledgerlake.plans.registry import Tables, query
from ledgerlake.plans.roles import CONFIG, with_ledger
from ledgerlake.session import scratch_path
from ledgerlake.sources import ledger_tables


def _statuses(t: Tables) -> DataFrame:
    return ledger.latest_statuses(roles.operations(t), CONFIG)


def _reconciled(t: Tables) -> DataFrame:
    return ledger.reconcile(roles.disk_changes(t), _statuses(t))


RECONCILED_SQL = """
, reconciled AS (
  SELECT coalesce(d.name, s.name) AS name, d.checksum, coalesce(s.status, 'pending') AS status, s.applied_at, s.applied_by,
         s.reverted_at, s.error_message, s.name IS NULL AS is_new, d.name IS NULL AS orphaned
  FROM disk_changes d FULL OUTER JOIN statuses s ON s.name = d.name)"""


@query("W1", with_ledger("SELECT * FROM statuses"))
def w1_latest_statuses(t: Tables) -> DataFrame:
    return _statuses(t)


RAN = """
, ran AS (
  SELECT e.filepath, e.checksum, e.status AS exec_status, o.status AS change_status
  FROM executions e JOIN operations o ON o.id = e.change_id WHERE o.config_name = 'prod' {condition}
  QUALIFY row_number() OVER (PARTITION BY e.filepath ORDER BY e.id DESC) = 1)"""
DECIDED = """
, decided AS (
  SELECT f.filepath, f.checksum, r.checksum AS old,
         CASE WHEN r.filepath IS NULL THEN 'new' WHEN exec_status = 'failed' THEN 'failed'
              WHEN exec_status IN ('pending', 'skipped') THEN 'new' WHEN change_status = 'stale' THEN 'stale'
              WHEN r.checksum <> f.checksum THEN 'changed' END AS reason
  FROM disk_files f LEFT JOIN ran r ON r.filepath = f.filepath)"""
DECISION_ROWS = """
SELECT filepath, checksum, reason IS NOT NULL AS needs_run, reason,
       CASE WHEN reason IS NULL THEN 'unchanged' END AS skip_reason,
       CASE WHEN reason IS DISTINCT FROM 'new' THEN old END AS previous_checksum
FROM decided"""


@query("J9", with_ledger(RAN.format(condition="AND e.status IN ('success', 'failed')") + "SELECT * FROM ran"))
def j9_latest_executions(t: Tables) -> DataFrame:
    return ledger.latest_executions(roles.executions(t), roles.operations(t), CONFIG)


@query("W2", with_ledger(RAN.format(condition="AND e.status IN ('success', 'failed')") + DECIDED + DECISION_ROWS))
def w2_file_decisions(t: Tables) -> DataFrame:
    return ledger.file_decisions(roles.disk_files(t), roles.executions(t), roles.operations(t), CONFIG)


@query("W1", with_ledger("SELECT * FROM statuses"))
def w1_laid_out(t: Tables) -> DataFrame:
    """From buckets by name."""
    with ledger_tables.laid_out(roles.operations(t), roles.executions(t), scratch_path(t.spark, "ledger")) as laid:
        return laid.latest_statuses(CONFIG)


@query("J9", with_ledger(RAN.format(condition="AND e.status IN ('success', 'failed')") + "SELECT * FROM ran"))
def j9_laid_out(t: Tables) -> DataFrame:
    """From buckets by operation."""
    with ledger_tables.laid_out(roles.operations(t), roles.executions(t), scratch_path(t.spark, "ledger")) as laid:
        return laid.latest_executions(CONFIG)


@query("W2", with_ledger(RAN.format(condition="AND e.status IN ('success', 'failed')") + DECIDED + DECISION_ROWS))
def w2_laid_out(t: Tables) -> DataFrame:
    with ledger_tables.laid_out(roles.operations(t), roles.executions(t), scratch_path(t.spark, "ledger")) as laid:
        return laid.file_decisions(roles.disk_files(t), CONFIG)


@query("W2", with_ledger(RAN.format(condition="AND o.id < 1000") + DECIDED + DECISION_ROWS))
def w2_file_decisions_strict(t: Tables) -> DataFrame:
    return ledger.file_decisions(
        roles.disk_files(t), roles.executions(t), roles.operations(t), CONFIG, before=1000, strict=True
    )


@query(
    "W2",
    with_ledger(
        ", torn AS (SELECT * REPLACE (CASE WHEN direction = 'change' AND status IN ('success', 'failed', 'pending') "
        "AND config_name = 'prod' THEN 'stale' ELSE status END AS status) FROM operations)"
        + RAN.format(condition="AND e.status IN ('success', 'failed')").replace("JOIN operations", "JOIN torn")
        + DECIDED
        + DECISION_ROWS
    ),
)
def w2_file_decisions_after_teardown(t: Tables) -> DataFrame:
    torn = ledger.mark_all_stale(roles.operations(t), CONFIG)
    return ledger.file_decisions(roles.disk_files(t), roles.executions(t), torn, CONFIG)


@query("W2", with_ledger("SELECT filepath, checksum, true AS needs_run, 'force' AS reason FROM disk_files"))
def w2_file_decisions_forced(t: Tables) -> DataFrame:
    forced = ledger.file_decisions(roles.disk_files(t), roles.executions(t), roles.operations(t), CONFIG, force=True)
    return forced.select("filepath", "checksum", "needs_run", "reason")


BY_NAME = """
SELECT d.name, d.checksum, reason IS NOT NULL AS needs_run, reason, CASE WHEN reason IS NULL THEN '{skip}' END AS skip_reason,
       previous_checksum, previous_status
FROM (
  SELECT d.*, l.checksum AS previous_checksum, l.status AS previous_status,
         CASE WHEN l.name IS NULL THEN 'new' WHEN l.status = 'failed' THEN 'failed' WHEN l.status = 'reverted' THEN '{reverted}'
              WHEN l.status = 'stale' THEN 'stale' WHEN l.checksum <> d.checksum THEN 'changed' END AS reason
  FROM disk_changes d LEFT JOIN {latest} l ON l.name = d.name) d"""


@query("W3", with_ledger(BY_NAME.format(skip="already applied", reverted="reverted", latest="latest")))
def w3_change_decisions(t: Tables) -> DataFrame:
    return ledger.change_decisions(roles.disk_changes(t), roles.operations(t), CONFIG)


@query(
    "W3",
    with_ledger(
        """
, newest AS (
  SELECT * REPLACE (CASE WHEN status = 'pending' THEN 'reverted' ELSE status END AS status) FROM operations
  WHERE direction = 'change' AND config_name = 'prod' QUALIFY row_number() OVER (PARTITION BY name ORDER BY id DESC) = 1)"""
        + BY_NAME.format(skip="already-run", reverted="stale", latest="newest")
    ),
)
def w3_change_decisions_any_type(t: Tables) -> DataFrame:
    operations = roles.operations(t)
    reverted = F.when(F.col("status") == "pending", "reverted").otherwise(F.col("status"))
    return ledger.change_decisions(
        roles.disk_changes(t), operations.withColumn("status", reverted), CONFIG, any_type=True
    )


@query(
    "W4",
    with_ledger("""
SELECT d.name, CASE WHEN s.status IS NULL THEN false ELSE s.status IN ('success', 'failed') END AS can_revert,
       CASE WHEN s.status IS NULL THEN 'not applied' WHEN s.status = 'pending' THEN 'not applied yet' END AS reason, s.status
FROM disk_changes d LEFT JOIN statuses s ON s.name = d.name"""),
)
def w4_revert_eligibility(t: Tables) -> DataFrame:
    return ledger.revert_eligibility(roles.disk_changes(t).select("name"), roles.operations(t), CONFIG)


@query("J10", with_ledger(RECONCILED_SQL + "SELECT * FROM reconciled ORDER BY name"))
def j10_reconcile(t: Tables) -> DataFrame:
    return _reconciled(t).orderBy("name")


@query("J11", with_ledger("SELECT name FROM statuses WHERE name NOT IN (SELECT name FROM disk_changes)"))
def j11_orphans(t: Tables) -> DataFrame:
    return ledger.orphans(_statuses(t), roles.disk_changes(t))


PENDING_SQL = RECONCILED_SQL + "SELECT * FROM reconciled WHERE NOT orphaned AND status IN ('pending', 'reverted') ORDER BY name"


@query("W7", with_ledger(PENDING_SQL + " LIMIT 10"))
def w7_next_changes(t: Tables) -> DataFrame:
    return ledger.next_changes(_reconciled(t), 10)


@query("W7", with_ledger(PENDING_SQL))
def w7_fast_forward(t: Tables) -> DataFrame:
    return ledger.fast_forward(_reconciled(t))


APPLIED_SQL = RECONCILED_SQL + """
, applied AS (
  SELECT *, row_number() OVER (ORDER BY applied_at DESC, name) AS place FROM reconciled
  WHERE NOT orphaned AND status = 'success' AND applied_at IS NOT NULL)"""


@query("W8", with_ledger(APPLIED_SQL + "SELECT * EXCLUDE (place) FROM applied WHERE place <= 5"))
def w8_rewind_count(t: Tables) -> DataFrame:
    return ledger.rewind_set(_reconciled(t), 5)


@query(
    "W8",
    with_ledger(
        APPLIED_SQL
        + "SELECT * EXCLUDE (place) FROM applied WHERE place <= (SELECT place FROM applied WHERE name = 'chg_107')"
    ),
)
def w8_rewind_to_name(t: Tables) -> DataFrame:
    return ledger.rewind_set(_reconciled(t), "chg_107")


@query("W9", with_ledger("SELECT id, cli_version, executed_at FROM operations ORDER BY id DESC LIMIT 1"))
def w9_latest_version(t: Tables) -> DataFrame:
    return ledger.latest_version(roles.operations(t).select("id", "cli_version", "executed_at"))


# --- batches ---------------------------------------------------------------------------------------------------------

BATCH_SQL = """
, batches AS (SELECT change_id AS batch, id AS seq, filepath, status FROM executions)
, stops AS (
  SELECT batch, min(seq) AS stop, arg_min(filepath, seq) AS by FROM batches WHERE status = 'failed' GROUP BY batch)
, cascaded AS (
  SELECT b.batch, b.seq, b.filepath, CASE WHEN b.seq > s.stop THEN 'skipped' ELSE b.status END AS status,
         CASE WHEN b.seq > s.stop THEN 'Skipped due to failure in ' || s.by ELSE '' END AS skip_reason
  FROM batches b LEFT JOIN stops s ON s.batch = b.batch)"""


def _batches(t: Tables) -> DataFrame:
    rows = roles.executions(t)
    return rows.select(F.col("change_id").alias("batch"), F.col("id").alias("seq"), "filepath", "status")


@query("W6", with_ledger(BATCH_SQL + "SELECT * FROM cascaded"))
def w6_abort_cascade(t: Tables) -> DataFrame:
    return ledger.abort_cascade(_batches(t))


@query(
    "A12",
    with_ledger(BATCH_SQL + """
SELECT batch, count(*) FILTER (WHERE status = 'success') AS files_run, count(*) FILTER (WHERE status = 'skipped') AS files_skipped,
       count(*) FILTER (WHERE status = 'failed') AS files_failed,
       CASE WHEN count(*) FILTER (WHERE status = 'failed') = 0 THEN 'success'
            WHEN count(*) FILTER (WHERE status = 'success') > 0 THEN 'partial' ELSE 'failed' END AS status,
       CASE WHEN count(*) FILTER (WHERE status = 'failed') = 0 THEN 'success' ELSE 'failed' END AS stored_status
FROM cascaded GROUP BY batch"""),
)
def a12_batch_rollup(t: Tables) -> DataFrame:
    return ledger.batch_rollup(ledger.abort_cascade(_batches(t)))


@query(
    "A11",
    "SELECT source, sha256(string_agg(h, '' ORDER BY h)) AS checksum FROM (SELECT source, sha256(text) AS h FROM documents) GROUP BY source",
)
def a11_combined_checksum(t: Tables) -> DataFrame:
    hashed = t.documents.select("source", F.sha2("text", 256).alias("checksum"))
    return ledger.combined_checksum(hashed, ["source"])


@query(
    "A13",
    with_ledger(
        RAN.format(condition="AND e.status IN ('success', 'failed')")
        + DECIDED
        + """
SELECT CASE WHEN reason IS NULL THEN 'previously-run' WHEN reason IN ('changed', 'failed') THEN reason ELSE 'new' END AS category,
       count(*) AS files, count(*) FILTER (WHERE reason IS NULL) AS would_skip
FROM decided GROUP BY 1"""
    ),
)
def a13_file_status_summary(t: Tables) -> DataFrame:
    return ledger.file_status_summary(w2_file_decisions(t))


# --- history ---------------------------------------------------------------------------------------------------------

HISTORY_SQL = """
SELECT id, name, change_type, direction, status, executed_at, executed_by, duration_ms, nullif(error_message, '') AS error_message,
       checksum
FROM operations WHERE config_name = 'prod' {condition} ORDER BY id DESC"""


@query("O7", with_ledger(HISTORY_SQL.format(condition="AND change_type = 'change' AND name = 'chg_7'") + " LIMIT 20"))
def o7_history_of_change(t: Tables) -> DataFrame:
    return ledger.history(roles.operations(t), CONFIG, name="chg_7", limit=20)


@query("O7 P8", with_ledger(HISTORY_SQL.format(condition="AND change_type IN ('build', 'run')")))
def o7_build_history(t: Tables) -> DataFrame:
    return ledger.history(roles.operations(t), CONFIG, types=("build", "run"))


@query(
    "O7",
    with_ledger("""
SELECT id, change_id, filepath, 'sql' AS file_type, checksum, status,
       CASE WHEN status = 'skipped' THEN 'unchanged' END AS skip_reason, CASE WHEN status = 'failed' THEN 'broken' END AS error_message,
       CAST(1 AS BIGINT) AS duration_ms
FROM executions WHERE change_id = 7 ORDER BY id"""),
)
def o7_files_of_operation(t: Tables) -> DataFrame:
    return ledger.files_of(roles.executions(t), 7)


@query(
    "L9",
    "SELECT o_orderkey AS config_name, o_orderdate AS expires_at FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01 00:00:00'",
)
def l9_expired_leases(t: Tables) -> DataFrame:
    leases = t.orders.select(F.col("o_orderkey").alias("config_name"), F.col("o_orderdate").alias("expires_at"))
    return ledger.expired_leases(leases, F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"))


# --- ledger updates --------------------------------------------------------------------------------------------------

STALE_TEST = "direction = 'change' AND status IN ('success', 'failed', 'pending') AND config_name = 'prod'"


@query(
    "M8",
    with_ledger(f"SELECT id, name, CASE WHEN {STALE_TEST} THEN 'stale' ELSE status END AS status FROM operations"),
)
def m8_mark_all_stale(t: Tables) -> DataFrame:
    return ledger.mark_all_stale(roles.operations(t), CONFIG).select("id", "name", "status")


@query("M8", with_ledger(f"SELECT count(*) FILTER (WHERE {STALE_TEST}) AS marked FROM operations"))
def m8_count_marked_stale(t: Tables) -> DataFrame:
    return ledger.count_to_mark_stale(roles.operations(t), CONFIG)


@query(
    "M8",
    with_ledger("""
SELECT o.id, o.name, CASE WHEN o.id IN (SELECT id FROM latest WHERE name IN (SELECT name FROM disk_changes)) THEN 'reverted'
       ELSE o.status END AS status
FROM operations o"""),
)
def m8_mark_reverted(t: Tables) -> DataFrame:
    marked = ledger.mark_reverted(roles.operations(t), roles.disk_changes(t), CONFIG)
    return marked.select("id", "name", "status")


def _closings(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderpriority") == "1-URGENT").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "F", "failed").otherwise("success").alias("status"),
        F.sha2("o_orderpriority", 256).alias("checksum"),
        (F.col("o_totalprice") / 16).alias("duration_ms"),
        F.when(F.col("o_orderstatus") == "F", F.repeat(F.lit("broken "), 300)).alias("error_message"),
    )


CLOSING_SQL = """
, closings AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'success' END AS status, sha256(o_orderpriority) AS checksum,
         o_totalprice / 16 AS duration_ms, CASE WHEN o_orderstatus = 'F' THEN repeat('broken ', 300) END AS error_message
  FROM orders WHERE o_orderpriority = '1-URGENT')"""


@query(
    "M13",
    with_ledger(CLOSING_SQL + """
SELECT o.id, CASE WHEN c.id IS NULL THEN o.status ELSE c.status END AS status,
       CASE WHEN c.id IS NULL THEN o.checksum ELSE c.checksum END AS checksum,
       CASE WHEN c.id IS NULL THEN o.duration_ms ELSE CAST(floor(c.duration_ms + 0.5) AS BIGINT) END AS duration_ms,
       CASE WHEN c.id IS NULL THEN o.error_message ELSE coalesce(c.error_message, '') END AS error_message
FROM operations o LEFT JOIN closings c ON c.id = o.id"""),
)
def m13_finalize_operations(t: Tables) -> DataFrame:
    closed = ledger.finalize(roles.operations(t), _closings(t))
    return closed.select("id", "status", "checksum", "duration_ms", "error_message")


@query(
    "M13",
    with_ledger(CLOSING_SQL + """
SELECT id, 'No operation record found with id ' || id AS error FROM closings WHERE id NOT IN (SELECT id FROM operations)"""),
)
def m13_unmatched_closings(t: Tables) -> DataFrame:
    return ledger.unmatched_closings(roles.operations(t), _closings(t))


@query(
    "M12",
    with_ledger("""
SELECT 'operation' AS kind, id FROM operations
WHERE NOT (name = 'chg_7' AND change_type = 'change' AND config_name = 'prod')
UNION ALL
SELECT 'execution', id FROM executions
WHERE change_id NOT IN (SELECT id FROM operations WHERE name = 'chg_7' AND change_type = 'change' AND config_name = 'prod')"""),
)
def m12_purge_change(t: Tables) -> DataFrame:
    operations, executions = ledger.purge(roles.operations(t), roles.executions(t), "chg_7", CONFIG)
    tagged = operations.select(F.lit("operation").alias("kind"), "id")
    return tagged.unionByName(executions.select(F.lit("execution").alias("kind"), "id"))
