"""Catalog browsing, truncate and teardown plans, over metadata tables derived from suppliers, parts and lineitems."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.scalar import label_of
from ledgerlake.operators import metadata, teardown
from ledgerlake.plans import roles
from ledgerlake.plans.registry import Tables, query
from ledgerlake.session import materialize

PREFIX = teardown.INTERNAL_PREFIX
TYPE_INDEX = {"STANDARD": 0, "PROMO": 1, "MEDIUM": 2, "ECONOMY": 3, "LARGE": 4, "SMALL": 5}
EVENTS = {"click": "INSERT", "view": "UPDATE", "error": "DELETE"}


def _table_name(number: Column) -> Column:
    return F.concat(F.when(number % 10 == 0, PREFIX).otherwise("tab_"), number)


def _brand_number() -> Column:
    return F.substr("p_brand", F.lit(7)).cast("int")


def tables(t: Tables) -> DataFrame:
    """One table or view per supplier."""
    is_view = F.col("s_acctbal") < 2000
    return t.supplier.select(
        F.concat(F.lit("s"), F.col("s_nationkey")).alias("table_schema"),
        _table_name(F.col("s_suppkey")).alias("table_name"),
        F.when(is_view, "view").otherwise("table").alias("kind"),
        F.when(is_view, F.concat(F.lit("SELECT "), F.col("s_suppkey"))).alias("definition"),
        F.when(F.col("s_acctbal") < 5000, 0).otherwise(F.floor("s_acctbal")).cast("bigint").alias("row_count"),
    )


def _once(t: Tables, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A frame that several parts of a query use: written the first time, read by all."""
    held = t.__dict__.setdefault("written", {})
    if name not in held:
        held[name] = materialize(make(), name)
    return held[name]


def _members(t: Tables, shared: bool) -> DataFrame:
    """Supplier, line number, part brand and part type that occur together; ``shared`` if several parts of a query use them."""

    def make() -> DataFrame:
        part = t.part.select("p_partkey", "p_brand", "p_type")
        used = t.lineitem.select("l_suppkey", "l_partkey", "l_linenumber").distinct()
        joined = used.join(part, F.col("l_partkey") == F.col("p_partkey"))
        return joined.select("l_suppkey", "l_linenumber", "p_brand", "p_type").distinct()

    return _once(t, "members", make) if shared else make()


def columns(t: Tables, shared: bool = False) -> DataFrame:
    """Columns of a supplier's table: the brand and type pairs of its parts, at most 25 by 6."""
    pairs = _members(t, shared).select("l_suppkey", "p_brand", "p_type").distinct()
    index = label_of(F.col("p_type"), {k: str(v) for k, v in TYPE_INDEX.items()}).cast("int")
    named = pairs.select(
        _table_name(F.col("l_suppkey")).alias("table_name"),
        F.concat(F.lit("c_"), F.lower("p_type"), F.lit("_"), _brand_number()).alias("column_name"),
        F.lower("p_type").alias("data_type"),
        (index > 2).alias("is_nullable"),
        (_brand_number() * 6 + index).alias("position"),
    )
    return tables(t).select("table_schema", "table_name").join(named, "table_name").select(
        "table_schema", "table_name", "column_name", "data_type", "is_nullable", F.lit(None).cast("string").alias("column_default"),
        "position",
    )


def keys(t: Tables, shared: bool = False) -> DataFrame:
    """Constraints of a supplier's table: one per line number, over the brands of its parts, at most 25."""
    line = F.col("l_linenumber")
    pairs = _members(t, shared).select("l_suppkey", "l_linenumber", "p_brand").distinct()
    foreign = line.isin(2, 3)
    named = pairs.select(
        _table_name(F.col("l_suppkey")).alias("table_name"),
        F.concat(F.lit("k"), line, F.lit("_"), F.col("l_suppkey")).alias("constraint_name"),
        F.when(line == 1, "primary").when(foreign, "foreign").when(line == 4, "unique").otherwise("index").alias("kind"),
        F.concat(F.lit("c_standard_"), _brand_number()).alias("column_name"),
        _brand_number().alias("position"),
        F.when(foreign, F.lit("s0")).alias("ref_schema"),
        F.when(foreign, _table_name(F.col("l_suppkey") + 1)).alias("ref_table"),
        F.when(foreign, F.concat(F.lit("r_"), _brand_number())).alias("ref_column"),
        F.when(foreign, "NO ACTION").alias("on_update"),
        F.when(line == 2, "CASCADE").when(line == 3, "NO ACTION").alias("on_delete"),
        line.isin(1, 4).alias("is_unique"),
    )
    return tables(t).select("table_schema", "table_name").join(named, "table_name")


def routines(t: Tables) -> DataFrame:
    return t.customer.select(
        F.concat(F.lit("s"), F.col("c_nationkey")).alias("routine_schema"),
        F.concat(F.lit("fn_"), F.col("c_custkey")).alias("routine_name"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "procedure").otherwise("function").alias("kind"),
        F.lower("c_mktsegment").alias("parameters"),
        F.col("c_nationkey").alias("parameter_count"),
        F.lit("int").alias("return_type"),
    )


def triggers(t: Tables) -> DataFrame:
    event = label_of(F.col("event_type"), EVENTS)
    return t.events.where(event.isNotNull()).select(
        F.lit("s0").alias("trigger_schema"),
        F.concat(F.lit("trg_"), F.col("user_id")).alias("trigger_name"),
        _table_name(F.col("user_id")).alias("table_name"),
        F.lit("AFTER").alias("timing"),
        event.alias("event"),
    )


def _name_sql(number: str) -> str:
    return f"CASE WHEN ({number}) % 10 = 0 THEN '{PREFIX}' ELSE 'tab_' END || ({number})"


META_SQL = f"""
WITH tables AS (
  SELECT s_suppkey, 's' || s_nationkey AS table_schema, {_name_sql("s_suppkey")} AS table_name,
         CASE WHEN s_acctbal < 2000 THEN 'view' ELSE 'table' END AS kind, CASE WHEN s_acctbal < 2000 THEN 'SELECT ' || s_suppkey END AS definition,
         CASE WHEN s_acctbal < 5000 THEN 0 ELSE CAST(floor(s_acctbal) AS BIGINT) END AS row_count
  FROM supplier)
, members AS (
  SELECT DISTINCT l_suppkey, l_linenumber, p_type, CAST(substr(p_brand, 7) AS INTEGER) AS brand,
         CASE p_type WHEN 'STANDARD' THEN 0 WHEN 'PROMO' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'ECONOMY' THEN 3 WHEN 'LARGE' THEN 4 ELSE 5 END AS i
  FROM lineitem JOIN part ON p_partkey = l_partkey)
, columns AS (
  SELECT DISTINCT table_schema, table_name, 'c_' || lower(p_type) || '_' || brand AS column_name, lower(p_type) AS data_type,
         i > 2 AS is_nullable, CAST(NULL AS VARCHAR) AS column_default, brand * 6 + i AS position
  FROM members JOIN tables ON s_suppkey = l_suppkey)
, keys AS (
  SELECT DISTINCT table_schema, table_name, 'k' || l_linenumber || '_' || l_suppkey AS constraint_name,
         CASE WHEN l_linenumber = 1 THEN 'primary' WHEN l_linenumber IN (2, 3) THEN 'foreign' WHEN l_linenumber = 4 THEN 'unique' ELSE 'index' END
           AS kind, 'c_standard_' || brand AS column_name, brand AS position, {_name_sql("l_suppkey + 1")} AS ref_table, 'r_' || brand AS ref_column,
         CASE WHEN l_linenumber = 2 THEN 'CASCADE' ELSE 'NO ACTION' END AS on_delete, l_linenumber IN (1, 4) AS is_unique
  FROM members JOIN tables ON s_suppkey = l_suppkey)
, triggers AS (
  SELECT DISTINCT 's0' AS trigger_schema, 'trg_' || user_id AS trigger_name, {_name_sql("user_id")} AS table_name, 'AFTER' AS timing,
         CASE event_type WHEN 'click' THEN 'INSERT' WHEN 'view' THEN 'UPDATE' ELSE 'DELETE' END AS event
  FROM events WHERE event_type IN ('click', 'view', 'error'))
"""


@query(
    "X1 P7",
    META_SQL
    + f"""
SELECT kind || 's' AS category, count(*) AS "count" FROM tables WHERE kind = 'view' OR NOT starts_with(table_name, '{PREFIX}') GROUP BY kind
UNION ALL SELECT CASE WHEN c_mktsegment = 'MACHINERY' THEN 'procedures' ELSE 'functions' END, count(*) FROM customer GROUP BY 1
UNION ALL SELECT CASE WHEN kind = 'foreign' THEN 'foreign_keys' ELSE 'indexes' END, count(DISTINCT (table_schema, table_name, constraint_name))
FROM keys WHERE NOT starts_with(table_name, '{PREFIX}') GROUP BY 1
UNION ALL SELECT 'triggers', count(DISTINCT trigger_name) FROM triggers WHERE NOT starts_with(table_name, '{PREFIX}')""",
)
def x1_overview(t: Tables) -> DataFrame:
    return metadata.overview(tables(t), routines(t), keys(t), triggers(t), PREFIX)


@query(
    "X2 J7",
    META_SQL
    + """
SELECT table_schema, table_name, (SELECT count(*) FROM columns c WHERE c.table_schema = t.table_schema AND c.table_name = t.table_name) AS column_count,
       nullif(row_count, 0) AS row_count
FROM tables t WHERE kind = 'table'""",
)
def x2_table_list(t: Tables) -> DataFrame:
    return metadata.table_list(tables(t), columns(t))


CATALOGUED = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@query(
    "X2",
    " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, (SELECT count(*) FROM (DESCRIBE {n})) AS column_count, nullif(count(*), 0) AS row_estimate FROM {n}" for n in CATALOGUED
    ),
)
def x2_estimated_rows(t: Tables) -> DataFrame:
    """The given tables entered in a catalog and analysed: row estimates from statistics, all tables in one call."""
    spark, database = t.spark, f"meta_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database}")
    try:
        for name in CATALOGUED:
            spark.catalog.createTable(f"{database}.{name}", path=f"{t.folder}/{name}.parquet", source="parquet")
        metadata.analyze(spark, database)
        listed = metadata.estimated_table_list(metadata.catalog_statistics(spark, database))
        return materialize(listed.drop("table_schema"), "estimates")
    finally:
        spark.sql(f"DROP DATABASE {database} CASCADE")


@query(
    "X3",
    META_SQL
    + """
SELECT table_schema, table_name, (SELECT count(*) FROM columns c WHERE c.table_schema = t.table_schema AND c.table_name = t.table_name) AS column_count,
       definition
FROM tables t WHERE kind = 'view'""",
)
def x3_view_list(t: Tables) -> DataFrame:
    return metadata.view_list(tables(t), columns(t))


@query(
    "X4",
    META_SQL
    + """
SELECT c.*, EXISTS (SELECT 1 FROM keys k WHERE k.kind = 'primary' AND k.table_schema = c.table_schema AND k.table_name = c.table_name
                    AND k.column_name = c.column_name) AS is_primary_key
FROM columns c""",
)
def x4_column_details(t: Tables) -> DataFrame:
    return metadata.column_details(columns(t, shared=True), keys(t, shared=True))


@query(
    "X4 A8",
    META_SQL
    + """
SELECT t.table_schema, t.table_name, nullif(row_count, 0) AS row_count,
       (SELECT string_agg(column_name, ',' ORDER BY position) FROM columns c WHERE c.table_schema = t.table_schema AND c.table_name = t.table_name)
         AS columns,
       coalesce((SELECT string_agg(DISTINCT constraint_name, ',' ORDER BY constraint_name) FROM keys k
        WHERE kind <> 'foreign' AND k.table_schema = t.table_schema AND k.table_name = t.table_name), '') AS indexes,
       coalesce((SELECT string_agg(DISTINCT constraint_name, ',' ORDER BY constraint_name) FROM keys k
        WHERE kind = 'foreign' AND k.table_schema = t.table_schema AND k.table_name = t.table_name), '') AS foreign_keys
FROM tables t WHERE kind = 'table'""",
)
def x4_table_detail(t: Tables) -> DataFrame:
    detail = metadata.table_detail(tables(t), columns(t, shared=True), keys(t, shared=True))
    names = {"columns": "columns.column_name", "indexes": "indexes", "foreign_keys": "foreign_keys"}
    return detail.select(
        "table_schema", "table_name", "row_count", *[F.array_join(source, ",").alias(name) for name, source in names.items()]
    )


@query(
    "X5 A8",
    META_SQL
    + """
SELECT table_schema, table_name, constraint_name, string_agg(column_name, ',' ORDER BY position) AS columns, is_unique,
       kind = 'primary' AS is_primary
FROM keys WHERE kind <> 'foreign' GROUP BY ALL""",
)
def x5_index_list(t: Tables) -> DataFrame:
    return metadata.index_list(keys(t)).withColumn("columns", F.array_join("columns", ","))


@query(
    "X6 A8",
    META_SQL
    + """
SELECT table_schema, table_name, constraint_name, 's0' AS ref_schema, ref_table, 'NO ACTION' AS on_update, on_delete,
       string_agg(column_name, ',' ORDER BY position) AS columns, string_agg(ref_column, ',' ORDER BY position) AS ref_columns
FROM keys WHERE kind = 'foreign' GROUP BY ALL""",
)
def x6_foreign_key_list(t: Tables) -> DataFrame:
    listed = metadata.foreign_key_list(keys(t))
    return listed.withColumns({c: F.array_join(c, ",") for c in ("columns", "ref_columns")})


@query(
    "J8",
    META_SQL
    + """
SELECT m.table_schema, m.constraint_name, m.position, m.column_name, r.ref_column, k.on_delete
FROM keys m JOIN keys r ON r.table_schema = m.table_schema AND r.constraint_name = m.constraint_name AND r.position = m.position
JOIN (SELECT DISTINCT table_schema, constraint_name, on_delete FROM keys) k ON k.table_schema = m.table_schema AND k.constraint_name = m.constraint_name
WHERE m.kind = 'foreign'""",
)
def j8_reference_pairs(t: Tables) -> DataFrame:
    rows = keys(t, shared=True)
    at = ["table_schema", "constraint_name"]
    return metadata.reference_pairs(
        rows.select(*at, "position", "column_name"),
        rows.select(*at, "kind").distinct(),
        rows.where(F.col("kind") == "foreign").select(*at, "position", "ref_column"),
        rows.where(F.col("kind") == "foreign").select(*at, "on_delete").distinct(),
    ).select(*at, "position", "column_name", "ref_column", "on_delete")


@query(
    "X7 A9 U2",
    META_SQL
    + """
SELECT trigger_schema, trigger_name, table_name, timing, string_agg(event, ',' ORDER BY event) AS events FROM triggers GROUP BY ALL""",
)
def x7_trigger_list(t: Tables) -> DataFrame:
    return metadata.trigger_list(triggers(t)).withColumn("events", F.array_join("events", ","))


@query(
    "X8",
    """
SELECT 's' || c_nationkey AS routine_schema, 'fn_' || c_custkey AS routine_name, c_nationkey AS parameter_count, lower(c_mktsegment) AS parameters,
       'int' AS return_type
FROM customer WHERE c_mktsegment <> 'MACHINERY'""",
)
def x8_function_list(t: Tables) -> DataFrame:
    return metadata.routine_list(routines(t))


# --- truncate and teardown -------------------------------------------------------------------------------------------


@query(
    "M10",
    META_SQL
    + f"""
SELECT table_name, CASE WHEN kept THEN 'preserved' ELSE 'truncated' END AS action,
       CASE WHEN NOT kept THEN 'TRUNCATE TABLE `' || table_name || '`' END AS statement
FROM (SELECT table_name, starts_with(table_name, '{PREFIX}') OR table_name IN ('tab_3', 'tab_7') AS kept FROM tables WHERE kind = 'table')""",
)
def m10_truncate_plan(t: Tables) -> DataFrame:
    return teardown.truncate_plan(tables(t).where(F.col("kind") == "table"), preserve=["tab_3", "tab_7"])


@query(
    "M10",
    META_SQL
    + f"""
SELECT table_name, CASE WHEN table_name IN ('tab_1', 'tab_2', 'tab_3', 'tab_4', 'tab_5', 'tab_6') THEN 'truncated' ELSE 'preserved' END AS action
FROM tables WHERE kind = 'table'""",
)
def m10_truncate_only_plan(t: Tables) -> DataFrame:
    only = [f"tab_{n}" for n in range(1, 7)]
    return teardown.truncate_plan(tables(t).where(F.col("kind") == "table"), only=only).select("table_name", "action")


KINDS = {"STANDARD": "table", "PROMO": "view", "MEDIUM": "function", "ECONOMY": "procedure", "LARGE": "type", "SMALL": "foreign_key"}
OBJECTS_SQL = f"""
WITH objects AS (
  SELECT CASE p_type WHEN 'STANDARD' THEN 'table' WHEN 'PROMO' THEN 'view' WHEN 'MEDIUM' THEN 'function' WHEN 'ECONOMY' THEN 'procedure'
           WHEN 'LARGE' THEN 'type' ELSE 'foreign_key' END AS kind,
         CASE WHEN p_type = 'STANDARD' THEN {_name_sql("p_partkey")} ELSE 'obj_' || p_partkey END AS name, {_name_sql("p_size")} AS table_name
  FROM part)
, judged AS (
  SELECT *, coalesce(CASE kind WHEN 'table' THEN starts_with(name, '{PREFIX}') OR name = 'tab_11'
         WHEN 'foreign_key' THEN starts_with(table_name, '{PREFIX}') OR table_name = 'tab_11' END, false) OR kind = 'function' AS kept
  FROM objects)
"""


def _objects(t: Tables) -> DataFrame:
    name = F.when(F.col("p_type") == "STANDARD", _table_name(F.col("p_partkey"))).otherwise(F.concat(F.lit("obj_"), F.col("p_partkey")))
    return t.part.select(
        label_of(F.col("p_type"), KINDS).alias("kind"), name.alias("name"), _table_name(F.col("p_size")).alias("table_name")
    )


def _plan(t: Tables) -> DataFrame:
    return teardown.teardown_plan(_objects(t), preserve_tables=["tab_11"], keep_kinds=["function"])


@query(
    "M11",
    OBJECTS_SQL
    + """
SELECT CASE kind WHEN 'foreign_key' THEN 1 WHEN 'view' THEN 2 WHEN 'table' THEN 3 WHEN 'function' THEN 4 WHEN 'procedure' THEN 5 ELSE 6 END AS step,
       kind, name, CASE WHEN kept THEN 'preserved' ELSE 'dropped' END AS action,
       CASE WHEN NOT kept THEN CASE WHEN kind = 'foreign_key' THEN 'ALTER TABLE `' || table_name || '` DROP CONSTRAINT `' || name || '`'
         ELSE 'DROP ' || upper(kind) || ' IF EXISTS `' || name || '`' END END AS statement
FROM judged""",
)
def m11_teardown_plan(t: Tables) -> DataFrame:
    return _plan(t)


@query(
    "M11 M8",
    OBJECTS_SQL
    + f"""
, ledger AS (
  SELECT event_id AS id, 'chg_' || user_id AS name,
         CASE WHEN event_type <> 'purchase' AND value >= 5 THEN 'stale' WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'view' THEN 'pending'
              ELSE 'success' END AS status
  FROM events)
SELECT id, name, status FROM ledger
UNION ALL SELECT max(id) + 1, '__reset__', 'success' FROM ledger""",
)
def m11_ledger_after_teardown(t: Tables) -> DataFrame:
    after = teardown.ledger_after_teardown(roles.operations(t), _plan(t), roles.CONFIG, "tester", roles.as_of())
    return after.select("id", "name", "status")


@query(
    "M11",
    OBJECTS_SQL
    + """
SELECT 'Schema teardown: dropped ' || count(*) FILTER (WHERE kind = 'table' AND NOT kept) || ' tables, '
       || count(*) FILTER (WHERE kind = 'view' AND NOT kept) || ' views, ' || count(*) FILTER (WHERE kind = 'function' AND NOT kept) || ' functions, '
       || count(*) FILTER (WHERE kind = 'procedure' AND NOT kept) || ' procedures' AS reason
FROM judged""",
)
def m11_reset_reason(t: Tables) -> DataFrame:
    after = teardown.ledger_after_teardown(roles.operations(t), _plan(t), roles.CONFIG, "tester", roles.as_of())
    return after.where(F.col("name") == "__reset__").select(F.col("error_message").alias("reason"))
