"""Joins whose left side may hold a third of its rows under one key.

Adaptive execution splits a skewed partition when both join sides come straight from a shuffle. It cannot when the
right side was aggregated by the join key, as the partitioning is then reused. These joins salt the key: the left rows
of a key spread over the salts, and the aggregated right side is repeated once per salt. The salted key needs its own
shuffle, so adaptive splitting works on top.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 8


def join_aggregated(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", salts: int = SALTS) -> DataFrame:
    """Join to a right side with one row per key (or, for semi and anti joins, any rows).

    The salt is the number of the task that holds the left row, so even equal rows spread, and a task that is rerun
    gives its rows the same salt.
    """
    salted = left.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    repeated = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*keys, "__salt"], how).drop("__salt")
