"""Catalog browsing over metadata tables (see ``schemas.META_*``), and how to fill them from the session catalog."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlake import schemas
from ledgerlake.operators.relational import exclude_prefix, ordered_array, table_counts, value_set

# --- from the session catalog ----------------------------------------------------------------------------------------


def describe(spark: SparkSession, table: str) -> dict:
    return json.loads(spark.sql(f"DESCRIBE EXTENDED {table} AS JSON").first()[0])


def analyze(spark: SparkSession, database: str = "default", pattern: str = "*") -> None:
    """Have Spark count the rows and bytes of a database's tables and keep them as statistics."""
    for entry in spark.catalog.listTables(database, pattern):
        if entry.tableType in ("MANAGED", "EXTERNAL"):
            spark.sql(f"ANALYZE TABLE `{database}`.`{entry.name}` COMPUTE STATISTICS")


def catalog_statistics(spark: SparkSession, database: str = "default", pattern: str = "*") -> DataFrame:
    """``table_schema, table_name, kind, column_count, row_estimate, size_in_bytes, definition`` of a database's tables and views.

    One call for all objects whose name fits the pattern (``*`` and ``|``), temporary views of the session with an empty schema included; no table is read and none is described by itself. Estimates are the
    counts of the last :func:`analyze`, null where there was none.
    """
    shown = spark.sql(f"SHOW TABLE EXTENDED IN `{database}` LIKE '{pattern}'")
    facts = F.col("information")
    fact = lambda expression: F.nullif(F.regexp_extract(facts, f"(?m)^{expression}", 1), F.lit(""))
    view = (fact("Type: (.*)$") == "VIEW") | F.col("isTemporary")
    return shown.select(
        F.col("namespace").alias("table_schema"),
        F.col("tableName").alias("table_name"),
        F.when(F.coalesce(view, F.lit(False)), "view").otherwise("table").alias("kind"),
        F.size(F.regexp_extract_all(facts, F.lit(r"(?m)^ \|-- "), F.lit(0))).cast("bigint").alias("column_count"),
        fact(r"Statistics: .*?(\d+) rows$").cast("bigint").alias("row_estimate"),
        fact(r"Statistics: (\d+) bytes").cast("bigint").alias("size_in_bytes"),
        fact(r"View Text: ([\s\S]*?)\nView Original Text: ").alias("definition"),
    )


def estimated_table_list(statistics: DataFrame, kind: str = "table") -> DataFrame:
    """Tables (or views) with their column count and estimated rows; an estimate of 0 shows as absent."""
    rows = statistics.where(F.col("kind") == kind)
    return rows.select("table_schema", "table_name", "column_count", F.when(F.col("row_estimate") > 0, F.col("row_estimate")).alias("row_estimate"))


def catalog_tables(spark: SparkSession, database: str = "default", pattern: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``tables`` and ``columns`` of a database. One driver call per object whose name fits the pattern: only names and types travel."""
    tables, columns = [], []
    for entry in spark.catalog.listTables(database, pattern):
        namespace = entry.namespace[0] if entry.namespace else ""
        name = f"`{namespace}`.`{entry.name}`" if namespace else f"`{entry.name}`"
        info = describe(spark, name)
        kind = "view" if "VIEW" in info["type"] else "table"
        if entry.isTemporary:
            kind = "view"
        tables.append((namespace, entry.name, kind, info.get("view_text"), None))
        for position, column in enumerate(info["columns"], start=1):
            columns.append(
                (
                    namespace, entry.name, column["name"], column["type"]["name"], column.get("nullable", True),
                    column.get("default"), position,
                )
            )
    return (
        spark.createDataFrame(tables, schemas.META_TABLES),
        spark.createDataFrame(columns, schemas.META_COLUMNS),
    )


def with_row_counts(tables: DataFrame) -> DataFrame:
    """Exact row counts of a catalog's tables, all counted in one job."""
    spark = tables.sparkSession
    names = [(r.table_schema, r.table_name) for r in tables.where(F.col("kind") == "table").collect()]
    if not names:
        return tables
    counts = table_counts({f"{schema}.{name}": spark.table(f"`{schema}`.`{name}`") for schema, name in names})
    counts = counts.select(F.col("table").alias("__name"), F.col("count").alias("__count"))
    at = F.concat_ws(".", "table_schema", "table_name") == F.col("__name")
    return tables.join(counts, at, "left").select(
        *[F.coalesce("__count", c).alias(c) if c == "row_count" else F.col(c) for c in tables.columns]
    )


def catalog_routines(spark: SparkSession, database: str = "default") -> DataFrame:
    """SQL functions with their parameters and return type, as the catalog describes them."""
    rows = []
    for entry in spark.catalog.listFunctions(database):
        if not (entry.className or "").startswith("sqlFunction"):
            continue
        facts = json.loads(entry.description)
        parameters = facts.get("sqlFunction.inputParam", "")
        count = len(StructType.fromDDL(parameters).fields) if parameters else 0
        namespace = entry.namespace[0] if entry.namespace else ""
        rows.append((namespace, entry.name, "function", parameters, count, facts.get("sqlFunction.returnType", "")))
    return spark.createDataFrame(rows, schemas.META_ROUTINES)


# --- queries ---------------------------------------------------------------------------------------------------------


def overview(
    tables: DataFrame, routines: DataFrame, keys: DataFrame, triggers: DataFrame, internal_prefix: str | None
) -> DataFrame:
    """Number of objects per category, without internal tables and what belongs to them."""

    def own(df: DataFrame, column: str) -> DataFrame:
        return df if internal_prefix is None else exclude_prefix(df, column, internal_prefix)

    constraint = F.struct("table_schema", "table_name", "constraint_name")
    internal = F.lit(False) if internal_prefix is None else F.startswith("table_name", F.lit(internal_prefix))
    relations = tables.where((F.col("kind") != "table") | ~internal)
    parts = [
        relations.groupBy(F.concat("kind", F.lit("s")).alias("category")).agg(F.count(F.lit(1)).alias("count")),
        routines.groupBy(F.concat("kind", F.lit("s")).alias("category")).agg(F.count(F.lit(1)).alias("count")),
        own(keys, "table_name")
        .groupBy(F.when(F.col("kind") == "foreign", "foreign_keys").otherwise("indexes").alias("category"))
        .agg(F.countDistinct(constraint).alias("count")),
        own(triggers, "table_name")
        .groupBy(F.lit("triggers").alias("category"))
        .agg(F.countDistinct(F.struct("trigger_schema", "trigger_name")).alias("count")),
    ]
    return reduce(DataFrame.unionByName, parts)


def table_list(tables: DataFrame, columns: DataFrame, kind: str = "table") -> DataFrame:
    """Tables (or views) with their column count and row count; a row count of 0 shows as absent."""
    at = ["table_schema", "table_name"]
    counted = columns.groupBy(*at).agg(F.count(F.lit(1)).alias("column_count"))
    return tables.where(F.col("kind") == kind).join(counted, at, "left").select(
        *at,
        F.coalesce("column_count", F.lit(0)).alias("column_count"),
        F.when(F.col("row_count") > 0, F.col("row_count")).alias("row_count"),
    )


def view_list(tables: DataFrame, columns: DataFrame) -> DataFrame:
    at = ["table_schema", "table_name"]
    definitions = tables.where(F.col("kind") == "view").select(*at, "definition")
    return table_list(tables, columns, "view").drop("row_count").join(definitions, at)


def column_details(columns: DataFrame, keys: DataFrame, table: str | None = None) -> DataFrame:
    """Columns with type, nullability, default, position, and whether they belong to the primary key."""
    at = ["table_schema", "table_name", "column_name"]
    primary = keys.where(F.col("kind") == "primary").select(*at).distinct().withColumn("__pk", F.lit(True))
    rows = columns if table is None else columns.where(F.col("table_name") == table)
    return rows.join(primary, at, "left").select(
        *columns.columns, F.coalesce("__pk", F.lit(False)).alias("is_primary_key")
    )


def table_detail(tables: DataFrame, columns: DataFrame, keys: DataFrame) -> DataFrame:
    """One row per table: its columns in order, index names, reference names, and row count."""
    at = ["table_schema", "table_name"]
    details = column_details(columns, keys).withColumn("column", F.struct("column_name", "data_type", "is_primary_key"))
    listed = ordered_array(details, at, "position", "column", "columns")
    names = keys.groupBy(*at).agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") != "foreign", F.col("constraint_name")))).alias("indexes"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "foreign", F.col("constraint_name")))).alias("foreign_keys"),
    )
    kept = table_list(tables, columns).select(*at, "row_count")
    none = F.array().cast("array<string>")
    joined = kept.join(listed, at, "left").join(names, at, "left")
    return joined.select(
        *at,
        "columns",
        F.coalesce("indexes", none).alias("indexes"),
        F.coalesce("foreign_keys", none).alias("foreign_keys"),
        "row_count",
    )


def index_list(keys: DataFrame) -> DataFrame:
    """Indexes (primary and unique keys too) with their columns in position order."""
    at = ["table_schema", "table_name", "constraint_name", "kind", "is_unique"]
    rows = keys.where(F.col("kind") != "foreign")
    return ordered_array(rows, at, "position", "column_name", "columns").select(
        *at[:3], "columns", "is_unique", (F.col("kind") == "primary").alias("is_primary")
    )


def foreign_key_list(keys: DataFrame) -> DataFrame:
    """Foreign keys with their column pairs in position order.

    Pairs stay together by position: joining the two column lists by constraint alone would multiply composite keys.
    """
    at = ["table_schema", "table_name", "constraint_name", "ref_schema", "ref_table", "on_update", "on_delete"]
    rows = keys.where(F.col("kind") == "foreign").withColumn("pair", F.struct("column_name", "ref_column"))
    return ordered_array(rows, at, "position", "pair", "pairs").select(
        *at, F.col("pairs.column_name").alias("columns"), F.col("pairs.ref_column").alias("ref_columns")
    )


def reference_pairs(members: DataFrame, constraints: DataFrame, referenced: DataFrame, rules: DataFrame) -> DataFrame:
    """Column pairs of foreign keys from four catalog tables, matched by constraint and position.

    members: constraint, position, column; constraints: constraint, kind; referenced: constraint, position, ref_column;
    rules: constraint, on_delete.
    """
    foreign = constraints.where(F.col("kind") == "foreign").select("table_schema", "constraint_name")
    at = ["table_schema", "constraint_name"]
    return members.join(foreign, at).join(referenced, [*at, "position"]).join(rules, at)


def trigger_list(triggers: DataFrame) -> DataFrame:
    """Triggers with their timing and set of events."""
    return value_set(triggers, ["trigger_schema", "trigger_name", "table_name", "timing"], "event", "events")


def routine_list(routines: DataFrame, kind: str = "function") -> DataFrame:
    rows = routines.where(F.col("kind") == kind)
    return rows.select("routine_schema", "routine_name", "parameter_count", "parameters", "return_type")
