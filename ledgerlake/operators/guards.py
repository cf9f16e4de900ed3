"""Checks that fail while a plan runs, instead of multiplying or dropping rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same rows, grouped by key; a key that stands in more than one row raises an error when the plan runs."""
    rest = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.any_value(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("__row"))
    error = F.raise_error(F.concat(F.lit("more than one row with the key "), F.to_json(F.struct(*keys))))
    checked = F.when(F.col("__n") > 1, error).otherwise(F.col("__row"))
    return grouped.withColumn("__row", checked).select(*keys, "__row.*").select(*[F.col(f"`{c}`") for c in df.columns])
