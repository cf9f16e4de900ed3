"""The ledger laid out as its indexes ask for: buckets by name, by id and by the operation of an execution.

A grouping by name and the join of executions with operations then read matching buckets side by side and shuffle nothing; a look-up of one name
opens one bucket. A bucket is read by one task, so a name that holds a large part of all records makes one task long; for such a ledger
the plain tables, which combine before the shuffle, are the better input.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.operators import ledger
from ledgerlake.operators.ranking import range_count


@dataclass(frozen=True)
class LaidOutLedger:
    spark: SparkSession
    tables: dict[str, str]  # role to catalog name

    @property
    def operations_by_name(self) -> DataFrame:
        return self.spark.table(self.tables["operations_by_name"])

    @property
    def operations(self) -> DataFrame:
        """The same rows in buckets of their id."""
        return self.spark.table(self.tables["operations_by_id"])

    @property
    def executions(self) -> DataFrame:
        return self.spark.table(self.tables["executions"])

    def latest_statuses(self, config: str) -> DataFrame:
        return ledger.latest_statuses(self.operations_by_name, config)

    def latest_executions(self, config: str, before: int | None = None, strict: bool = False) -> DataFrame:
        return ledger.latest_executions(self.executions, self.operations, config, before, strict)

    def file_decisions(self, files: DataFrame, config: str, before: int | None = None, strict: bool = False) -> DataFrame:
        return ledger.file_decisions(files, self.executions, self.operations, config, before=before, strict=strict)

    def change_decisions(self, changes: DataFrame, config: str) -> DataFrame:
        return ledger.change_decisions(changes, self.operations_by_name, config)

    def history_of(self, name: str, config: str) -> DataFrame:
        """All records of one name, newest first: one bucket is read."""
        rows = self.operations_by_name.where((F.col("name") == name) & (F.col("config_name") == config))
        return rows.orderBy(F.col("id").desc())

    def append(self, operations: DataFrame, executions: DataFrame) -> None:
        """Add records; each append adds a file to the buckets it touches."""
        for role, (rows, key, order) in _layout(operations, executions).items():
            _write(rows, self.tables[role], key, order, self._buckets(role), None)

    def _buckets(self, role: str) -> int:
        described = self.spark.sql(f"DESCRIBE EXTENDED {self.tables[role]}").where("col_name = 'Num Buckets'")
        return int(described.first()["data_type"])


def _layout(operations: DataFrame, executions: DataFrame) -> dict[str, tuple[DataFrame, str, list[str]]]:
    return {
        "operations_by_name": (operations, "name", ["name", "id"]),
        "operations_by_id": (operations, "id", ["id"]),
        "executions": (executions, "change_id", ["change_id", "id"]),
    }


def _write(rows: DataFrame, table: str, key: str, order: list[str], buckets: int, path: str | None) -> None:
    # dealt as the buckets are, so that a task writes one file
    writer = rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(*order).format("parquet").mode("append")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def lay_out(operations: DataFrame, executions: DataFrame, path: str, prefix: str = "ledger", buckets: int | None = None) -> LaidOutLedger:
    """Write the three tables below ``path`` and enter them in the catalog as ``prefix_role``.

    All have the same number of buckets, by default as many as the larger input has ranges.
    """
    spark = operations.sparkSession
    count = buckets or max(range_count(operations), range_count(executions))
    tables = {role: f"{prefix}_{role}" for role in _layout(operations, executions)}
    for role, (rows, key, order) in _layout(operations, executions).items():
        _write(rows, tables[role], key, order, count, f"{path}/{role}")
    return LaidOutLedger(spark, tables)


@contextmanager
def laid_out(operations: DataFrame, executions: DataFrame, path: str, buckets: int | None = None) -> Iterator[LaidOutLedger]:
    """A laid-out ledger under names of its own, which leave the catalog at the end; plans made inside stay valid, as the files stay."""
    made = lay_out(operations, executions, path, f"ledger_{uuid.uuid4().hex}", buckets)
    try:
        yield made
    finally:
        for table in made.tables.values():
            made.spark.sql(f"DROP TABLE {table}")
