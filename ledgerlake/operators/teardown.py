"""Truncate and teardown: first a plan as rows, then its statements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.operators import ledger

INTERNAL_PREFIX = "__ledger_"

# Order in which kinds of objects are dropped, and their statements.
DROP_ORDER = ("foreign_key", "view", "table", "function", "procedure", "type")
DROP_STATEMENTS = {
    "foreign_key": ("ALTER TABLE ", " DROP CONSTRAINT "),
    "view": ("DROP VIEW IF EXISTS ",),
    "table": ("DROP TABLE IF EXISTS ",),
    "function": ("DROP FUNCTION IF EXISTS ",),
    "procedure": ("DROP PROCEDURE IF EXISTS ",),
    "type": ("DROP TYPE IF EXISTS ",),
}


def _quoted(name: Column) -> Column:
    return F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`"))


def _listed(column: Column, names: Sequence[str]) -> Column:
    return column.isin(list(names)) if names else F.lit(False)


def truncate_plan(
    tables: DataFrame,
    only: Sequence[str] | None = None,
    preserve: Sequence[str] = (),
    internal_prefix: str = INTERNAL_PREFIX,
) -> DataFrame:
    """Which tables are emptied. Ledger tables are always kept, then ``preserve``, then what ``only`` leaves out."""
    name = F.col("table_name")
    kept = F.startswith(name, F.lit(internal_prefix)) | _listed(name, preserve)
    if only is not None:
        kept = kept | ~_listed(name, only)
    return tables.select(
        "table_name",
        F.when(kept, "preserved").otherwise("truncated").alias("action"),
        F.when(~kept, F.concat(F.lit("TRUNCATE TABLE "), _quoted(name))).alias("statement"),
    )


def teardown_plan(
    objects: DataFrame,
    preserve_tables: Sequence[str] = (),
    keep_kinds: Sequence[str] = (),
    internal_prefix: str = INTERNAL_PREFIX,
) -> DataFrame:
    """What is dropped and in which order, from ``kind, name, table_name`` rows.

    ``keep_kinds`` leaves out views, functions, procedures or types. Preserved tables keep their foreign keys.
    """
    kind, name = F.col("kind"), F.col("name")
    table = F.when(kind == "table", name).when(kind == "foreign_key", F.col("table_name"))
    kept = F.coalesce(F.startswith(table, F.lit(internal_prefix)) | _listed(table, preserve_tables), F.lit(False))
    kept = kept | _listed(kind, [k for k in keep_kinds if k not in ("table", "foreign_key")])
    step, statement = None, None
    for number, known in enumerate(DROP_ORDER, start=1):
        words = DROP_STATEMENTS[known]
        text = (
            F.concat(F.lit(words[0]), _quoted(F.col("table_name")), F.lit(words[1]), _quoted(name))
            if len(words) == 2
            else F.concat(F.lit(words[0]), _quoted(name))
        )
        step = F.when(kind == known, number) if step is None else step.when(kind == known, number)
        statement = F.when(kind == known, text) if statement is None else statement.when(kind == known, text)
    return objects.select(
        step.alias("step"),
        "kind",
        "name",
        F.when(kept, "preserved").otherwise("dropped").alias("action"),
        F.when(~kept, statement).alias("statement"),
    )


def run_plan(plan: DataFrame, dry_run: bool = False, order: Sequence[str] = ("step", "name")) -> list[str]:
    """Run a plan's statements in order and return them. DDL is driver work: one row per catalog object."""
    columns = [c for c in order if c in plan.columns] or ["table_name"]
    rows = plan.where(F.col("statement").isNotNull()).orderBy(*columns).select("statement").collect()
    statements = [row["statement"] for row in rows]
    if not dry_run:
        for statement in statements:
            plan.sparkSession.sql(statement)
    return statements


def ledger_after_teardown(
    operations: DataFrame, plan: DataFrame, config: str, executed_by: str, as_of: Column
) -> DataFrame:
    """The ledger after a teardown: forward records stale, plus one record of the reset with the dropped counts."""
    counts = plan.where(F.col("action") == "dropped").agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("table", "view", "function", "procedure")]
    )
    reason = counts.select(
        F.concat(
            F.lit("Schema teardown: dropped "), F.col("table"), F.lit(" tables, "), F.col("view"), F.lit(" views, "),
            F.col("function"), F.lit(" functions, "), F.col("procedure"), F.lit(" procedures"),
        ).alias("reason")
    )
    stale = ledger.mark_all_stale(operations, config)
    record = ledger.reset_record(operations, config, executed_by, "", as_of)
    record = record.withColumn("error_message", reason.scalar())
    return stale.unionByName(record.select(*operations.columns))
