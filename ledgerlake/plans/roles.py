"""The roles the driver's tables play, as DataFrames and as SQL common table expressions.

users = customer, lists = orders, items = lineitem; ledger records come from events, file executions from orders,
files from part and documents. Both forms state the same derivation, so a query and its SQL start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.scalar import label_of
from ledgerlake.plans.registry import Tables

AS_OF = "2024-02-01 00:00:00"
CONFIG = "prod"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


# Ledger status of each event type; any other type is a success.
STATUS = {"error": "failed", "view": "pending"}
CHANGE_TYPE = {"signup": "build"}
EXECUTION_STATUS = {"F": "failed", "O": "success"}


def users(t: Tables) -> DataFrame:
    low = F.lower(F.replace("c_name", F.lit("#"), F.lit(".")))
    return t.customer.select(
        F.col("c_custkey").alias("id"),
        F.concat(low, F.when(F.col("c_nationkey") < 20, "@example.com").otherwise("@example")).alias("email"),
        F.col("c_name").alias("username"),
        F.sha2("c_name", 256).alias("password_hash"),
        F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("display_name"),
        F.col("c_nationkey").alias("nation_id"),
        F.when(F.col("c_acctbal") < 0, as_of()).alias("deleted_at"),
    )


def lists(t: Tables) -> DataFrame:
    color = F.when(F.col("o_orderpriority") == "1-URGENT", "#FF0000").when(F.col("o_orderpriority") == "2-HIGH", "#ff88zz")
    return t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.concat(F.lit("List "), F.col("o_orderkey")).alias("title"),
        color.alias("color"),
        F.floor(F.col("o_totalprice")).cast("int").alias("position"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate")).alias("deleted_at"),
    )


def items(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").alias("list_id"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_linenumber").alias("position"),
        (F.col("l_linenumber") - 1).alias("priority"),
        (F.col("l_linestatus") == "F").alias("is_completed"),
        F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")).alias("completed_at"),
        F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")).alias("deleted_at"),
    )


TODO_SQL = f"""
users AS (
  SELECT c_custkey AS id,
         lower(replace(c_name, '#', '.')) || CASE WHEN c_nationkey < 20 THEN '@example.com' ELSE '@example' END AS email,
         c_name AS username, sha256(c_name) AS password_hash, nullif(c_mktsegment, 'MACHINERY') AS display_name,
         c_nationkey AS nation_id, CASE WHEN c_acctbal < 0 THEN TIMESTAMP '{AS_OF}' END AS deleted_at
  FROM customer),
lists AS (
  SELECT o_orderkey AS id, o_custkey AS user_id, 'List ' || o_orderkey AS title,
         CASE o_orderpriority WHEN '1-URGENT' THEN '#FF0000' WHEN '2-HIGH' THEN '#ff88zz' END AS color,
         CAST(floor(o_totalprice) AS INTEGER) AS position, o_orderdate AS created_at, o_orderdate AS updated_at,
         CASE WHEN o_orderstatus = 'P' THEN o_orderdate END AS deleted_at
  FROM orders),
items AS (
  SELECT l_orderkey AS list_id, l_partkey AS part_id, l_linenumber AS position, l_linenumber - 1 AS priority,
         l_linestatus = 'F' AS is_completed, CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS completed_at,
         CASE WHEN l_returnflag = 'R' THEN l_shipdate END AS deleted_at
  FROM lineitem)"""


def _stepped_checksum(number: Column, cut: int) -> Column:
    return F.sha2(F.when(number >= cut, "second").otherwise("first"), 256)


def operations(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("chg_"), F.col("user_id")).alias("name"),
        F.coalesce(label_of(F.col("event_type"), CHANGE_TYPE), F.lit("change")).alias("change_type"),
        F.when(F.col("event_type") == "purchase", "revert").otherwise("change").alias("direction"),
        _stepped_checksum(F.col("value"), 50).alias("checksum"),
        F.col("ts").alias("executed_at"),
        F.concat(F.lit("user "), F.col("user_id")).alias("executed_by"),
        F.when(F.col("value") < 5, "dev").otherwise(CONFIG).alias("config_name"),
        F.lit("1.0.0").alias("cli_version"),
        F.coalesce(label_of(F.col("event_type"), STATUS), F.lit("success")).alias("status"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("failed: "), "props")).otherwise("").alias("error_message"),
        F.floor(F.col("value") * 10).alias("duration_ms"),
    )


def executions(t: Tables) -> DataFrame:
    status = F.coalesce(
        F.when(F.col("o_orderpriority") == "5-LOW", "skipped"),
        label_of(F.col("o_orderstatus"), EXECUTION_STATUS),
        F.lit("pending"),
    )
    return t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("change_id"),
        file_path(F.floor(F.col("o_totalprice") / 100).cast("bigint")).alias("filepath"),
        F.lit("sql").alias("file_type"),
        F.sha2(F.when(F.col("o_orderpriority") == "1-URGENT", "first").otherwise("second"), 256).alias("checksum"),
        F.lit("1.0.0").alias("cli_version"),
        status.alias("status"),
        F.when(status == "failed", "broken").otherwise("").alias("error_message"),
        F.when(status == "skipped", "unchanged").otherwise("").alias("skip_reason"),
        F.lit(1).cast("bigint").alias("duration_ms"),
    )


def file_path(number: Column) -> Column:
    return F.concat(F.lit("sql/"), label_of(number % 3, {0: "tables", 1: "views"}, "seeds"), F.lit("/t_"), number, F.lit(".sql"))


def disk_files(t: Tables) -> DataFrame:
    """Files on disk, one per part."""
    return t.part.select(
        file_path(F.col("p_partkey")).alias("filepath"), _stepped_checksum(F.col("p_size"), 10).alias("checksum")
    )


def disk_changes(t: Tables) -> DataFrame:
    """Changes on disk, one per customer; the ledger knows those whose key is a user id."""
    return t.customer.where(F.col("c_mktsegment") != "BUILDING").select(
        F.concat(F.lit("chg_"), F.col("c_custkey")).alias("name"),
        _stepped_checksum(F.col("c_acctbal"), 5000).alias("checksum"),
    )


def corpus(t: Tables) -> DataFrame:
    suffix = label_of(F.col("lang"), {"de": ".sql.tmpl", "es": ".md"}, ".sql")
    return t.documents.select(
        "doc_id",
        F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id"), suffix).alias("path"),
        F.col("text").alias("content"),
    )


LEDGER_SQL = f"""
operations AS (
  SELECT event_id AS id, 'chg_' || user_id AS name,
         CASE WHEN event_type = 'signup' THEN 'build' ELSE 'change' END AS change_type,
         CASE WHEN event_type = 'purchase' THEN 'revert' ELSE 'change' END AS direction,
         sha256(CASE WHEN value >= 50 THEN 'second' ELSE 'first' END) AS checksum, ts AS executed_at,
         'user ' || user_id AS executed_by, CASE WHEN value < 5 THEN 'dev' ELSE '{CONFIG}' END AS config_name,
         '1.0.0' AS cli_version,
         CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'pending' ELSE 'success' END AS status,
         CASE WHEN event_type = 'error' THEN 'failed: ' || props ELSE '' END AS error_message,
         CAST(floor(value * 10) AS BIGINT) AS duration_ms
  FROM events),
executions AS (
  SELECT o_orderkey AS id, o_custkey AS change_id, n,
         'sql/' || CASE n % 3 WHEN 0 THEN 'tables' WHEN 1 THEN 'views' ELSE 'seeds' END || '/t_' || n || '.sql' AS filepath,
         sha256(CASE WHEN o_orderpriority = '1-URGENT' THEN 'first' ELSE 'second' END) AS checksum,
         CASE WHEN o_orderpriority = '5-LOW' THEN 'skipped' WHEN o_orderstatus = 'F' THEN 'failed'
              WHEN o_orderstatus = 'O' THEN 'success' ELSE 'pending' END AS status
  FROM (SELECT *, CAST(floor(o_totalprice / 100) AS BIGINT) AS n FROM orders)),
disk_files AS (
  SELECT 'sql/' || CASE p_partkey % 3 WHEN 0 THEN 'tables' WHEN 1 THEN 'views' ELSE 'seeds' END || '/t_' || p_partkey
           || '.sql' AS filepath,
         sha256(CASE WHEN p_size >= 10 THEN 'second' ELSE 'first' END) AS checksum
  FROM part),
disk_changes AS (
  SELECT 'chg_' || c_custkey AS name, sha256(CASE WHEN c_acctbal >= 5000 THEN 'second' ELSE 'first' END) AS checksum
  FROM customer WHERE c_mktsegment <> 'BUILDING'),
forward AS (
  SELECT * FROM operations WHERE change_type = 'change' AND direction = 'change' AND config_name = '{CONFIG}'),
latest AS (SELECT * FROM forward QUALIFY row_number() OVER (PARTITION BY name ORDER BY id DESC) = 1),
statuses AS (
  SELECT l.name, l.status, l.executed_at AS applied_at, l.executed_by AS applied_by, r.executed_at AS reverted_at,
         nullif(l.error_message, '') AS error_message
  FROM latest l LEFT JOIN (
    SELECT name, executed_at FROM operations
    WHERE change_type = 'change' AND direction = 'revert' AND status = 'success' AND config_name = '{CONFIG}'
    QUALIFY row_number() OVER (PARTITION BY name ORDER BY id DESC) = 1) r ON r.name = l.name)"""

CORPUS_SQL = """
corpus AS (
  SELECT doc_id, source || '/' || lang || '/' || doc_id
           || CASE lang WHEN 'de' THEN '.sql.tmpl' WHEN 'es' THEN '.md' ELSE '.sql' END AS path, text AS content
  FROM documents)"""


def with_todo(sql: str) -> str:
    return f"WITH {TODO_SQL.strip()}\n{sql.strip()}"


def with_ledger(sql: str) -> str:
    return f"WITH {LEDGER_SQL.strip()}\n{sql.strip()}"


def with_corpus(sql: str) -> str:
    return f"WITH {CORPUS_SQL.strip()}\n{sql.strip()}"
