"""Violations of keys, references and checks, as rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _all_present(columns: Sequence[str]) -> Column:
    return reduce(and_, [F.col(c).isNotNull() for c in columns])


def unique_violations(df: DataFrame, keys: Sequence[str], nulls_distinct: bool = True) -> DataFrame:
    """Key values that occur more than once, with their count. A unique key ignores rows with a null part."""
    rows = df.where(_all_present(keys)) if nulls_distinct else df
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def primary_key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Duplicate key values, and null keys (which a primary key also forbids)."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.where((F.col("n") > 1) | ~_all_present(keys))


def reference_violations(child: DataFrame, columns: Sequence[str], parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Referring values without a parent, with their row count. A null part passes.

    Child rows are counted per value first, so a hot value moves as one row per task.
    """
    used = child.where(_all_present(columns)).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    known = parent.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)]).distinct()
    return used.join(known, [used[c] == known[f"__{i}"] for i, c in enumerate(columns)], "left_anti")


def check_violations(df: DataFrame, required: Sequence[str] = (), checks: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows that break a rule, once per rule. Null breaks NOT NULL, and passes a CHECK."""
    rules = {f"{c} is not null": F.col(c).isNotNull() for c in required} | dict(checks or {})
    broken = F.array(*[F.when(~test, F.lit(name)) for name, test in rules.items()])
    return df.withColumn("rule", F.explode(F.filter(broken, lambda r: r.isNotNull())))
