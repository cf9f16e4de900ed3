"""Seed data: CSV, JSON5, and appends to tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from ledgerlake.functions.json5 import strict_json

def read_csv_seed(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """CSV with a header: trimmed, blank lines skipped, every column a string; an empty cell is ``''``.

    Files are split among tasks. Only a file whose cells hold line breaks must be read by one task: pass ``multiline=True``.
    """
    rows = spark.read.csv(
        path, header=True, inferSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True,
        quote='"', escape='"', multiLine=multiline,
    )
    return rows.na.fill("")


def read_json_seed(spark: SparkSession, path: str, schema: StructType | str | None = None, per_line: bool = False) -> DataFrame:
    """JSON or JSON5 seed files; an array document gives one row per element.

    ``per_line``: every line is a document (or a comment), so that files are split among tasks. Else a file is one document, read by one task
    and limited to 2 GB. Without a schema it is inferred from all documents in a pass of its own; columns come in the order of their
    names. A document that cannot be read gives a row of nulls.
    """
    texts = spark.read.text(path, wholetext=not per_line)
    documents = texts.select(strict_json(F.col("value")).alias("value")).where(F.col("value") != "")
    kind = inferred_schema(documents) if schema is None else StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if kind is None:
        return spark.createDataFrame([], "value STRING").drop("value")
    row = F.array(F.from_json("value", kind))
    rows = F.when(F.startswith("value", F.lit("[")), F.coalesce(F.from_json("value", ArrayType(kind)), row)).otherwise(row)
    return documents.select(F.explode(rows).alias("r")).select("r.*")


def inferred_schema(documents: DataFrame) -> StructType | None:
    """Columns of all documents (strict JSON in ``value``); None if no document has any."""
    parsed = documents.select(F.try_parse_json("value").alias("v"))
    elements = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    found = parsed.select(F.explode(elements).alias("e")).where(F.schema_of_variant("e").startswith("OBJECT")).agg(F.schema_of_variant_agg("e")).first()[0]
    if not found or not found.startswith("OBJECT<"):
        return None
    kind = re.sub(r"DECIMAL\(\d+,\s*\d+\)", "DOUBLE", found).replace("OBJECT<>", "STRING").replace("OBJECT<", "STRUCT<").replace("VOID", "STRING")
    return DataType.fromDDL(kind)


def with_json_text(rows: DataFrame) -> DataFrame:
    """Array columns as JSON text, which is how a seed stores a list in a text column."""
    return rows.select(
        *[
            F.to_json(f.name).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name)
            for f in rows.schema.fields
        ]
    )


def append_rows(rows: DataFrame, table: str, columns: Sequence[str] | None = None) -> None:
    """Append seed rows to a table, by position of its columns."""
    with_json_text(rows.select(*columns) if columns else rows).write.mode("append").insertInto(table)
