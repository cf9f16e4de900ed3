"""Fixed schemas of the ledger, log and metadata tables.

The ledger stores "none" as ``''`` or ``0``; readers map ``''`` back to null.
"""

from __future__ import annotations

from pyspark.sql import types as T


TYPES = {
    "STRING": T.StringType(), "INT": T.IntegerType(), "BIGINT": T.LongType(), "DOUBLE": T.DoubleType(),
    "BOOLEAN": T.BooleanType(), "TIMESTAMP": T.TimestampType(),
}


def _struct(fields: str) -> T.StructType:
    """``name TYPE, …``; unlike Spark's own DDL parser this needs no running session."""
    pairs = [field.split() for field in fields.split(",")]
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in pairs])


OPERATIONS = _struct(
    "id BIGINT, name STRING, change_type STRING, direction STRING, checksum STRING, executed_at TIMESTAMP, "
    "executed_by STRING, config_name STRING, cli_version STRING, status STRING, error_message STRING, duration_ms BIGINT"
)
EXECUTIONS = _struct(
    "id BIGINT, change_id BIGINT, filepath STRING, file_type STRING, checksum STRING, cli_version STRING, "
    "status STRING, error_message STRING, skip_reason STRING, duration_ms BIGINT"
)
VERSIONS = _struct(
    "id BIGINT, cli_version STRING, ledger_version INT, state_version INT, settings_version INT, "
    "installed_at TIMESTAMP, upgraded_at TIMESTAMP"
)
LEASES = _struct("config_name STRING, locked_by STRING, locked_at TIMESTAMP, expires_at TIMESTAMP, reason STRING")
IDENTITIES = _struct(
    "identity_hash STRING, email STRING, name STRING, machine STRING, os STRING, public_key STRING, "
    "registered_at TIMESTAMP, last_seen_at TIMESTAMP"
)
LOG_ENTRY = _struct("time STRING, level STRING, type STRING, message STRING, data STRING, context STRING")
QUERY_HISTORY = _struct(
    "id STRING, query STRING, executed_at TIMESTAMP, duration_ms DOUBLE, success BOOLEAN, error_message STRING, "
    "row_count BIGINT, results_path STRING"
)
AUDIT_LOG = _struct(
    "table_name STRING, operation STRING, row_id STRING, old_data STRING, new_data STRING, changed_at TIMESTAMP"
)

# Metadata tables: one row per object, per column, per key member, per trigger event.
META_TABLES = _struct("table_schema STRING, table_name STRING, kind STRING, definition STRING, row_count BIGINT")
META_COLUMNS = _struct(
    "table_schema STRING, table_name STRING, column_name STRING, data_type STRING, is_nullable BOOLEAN, "
    "column_default STRING, position INT"
)
META_KEYS = _struct(
    "table_schema STRING, table_name STRING, constraint_name STRING, kind STRING, column_name STRING, position INT, "
    "ref_schema STRING, ref_table STRING, ref_column STRING, on_update STRING, on_delete STRING, is_unique BOOLEAN"
)
META_ROUTINES = _struct(
    "routine_schema STRING, routine_name STRING, kind STRING, parameters STRING, parameter_count INT, return_type STRING"
)
META_TRIGGERS = _struct(
    "trigger_schema STRING, trigger_name STRING, table_name STRING, timing STRING, event STRING"
)
