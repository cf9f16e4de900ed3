"""Row numbers, pages and column sorts that hold for one hot group or no grouping at all.

``row_number()`` over an unpartitioned or hot window runs in one task. Here the rows are partitioned by ranges of the sort
order and written in order; a row's number follows from its place in its range and the counts of the earlier ranges. A range
holds about 1/n of all rows whatever the group sizes are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerlake.session import materialize

#: About as many bytes of input make one range.
RANGE_BYTES = 128 << 20
#: Pages that end by this row are found by a bounded top-n.
NEAR_ROWS = 10_000
#: Epoch seconds and milliseconds from 2001 to 2033: whole numbers that may be dates.
EPOCH_RANGES = ((1e9, 2e9), (1e12, 2e12))
DATE_TEXT = r"^(\d{4}-\d{2}-\d{2}|\d{1,2}[/-]\d{1,2}[/-]\d{2,4})"

# Column names that suggest a date or an id, best first.
DATE_NAMES = [
    "^created[_-]?at$", "^updated[_-]?at$", "^modified[_-]?at$", "^timestamp$", "^datetime$", "^date$",
    "[_-]at$", "[_-]date$", "[_-]time$", "^created$", "^updated$", "^modified$",
]
ID_NAMES = ["^id$", "^_id$", "[_-]id$"]


def estimated_bytes(df: DataFrame) -> int:
    return _plan_bytes(df._jdf.queryExecution().optimizedPlan())


def _plan_bytes(plan) -> int:
    return int(str(plan.stats().sizeInBytes()))


def range_count(df: DataFrame) -> int:
    """Number of ranges from the estimated size of the input, at least the session's number of shuffle partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = math.ceil(estimated_bytes(df) / RANGE_BYTES)
    if count > 100 * least:  # a join's estimate, the product of its sides', may be beyond any real size: what is read counts
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        count = math.ceil(sum(_plan_bytes(leaves.apply(i)) for i in range(leaves.size())) / RANGE_BYTES)
    return max(least, min(count, 100 * least))


def number_rows(
    df: DataFrame,
    order: Sequence[str],
    within: Sequence[str] = (),
    descending: bool = False,
    name: str = "row_num",
    ranges: int | None = None,
) -> DataFrame:
    """``row_number()`` per ``within`` group (or over all rows) without a task that holds a whole group.

    ``order`` must end in a unique column. Nulls come first ascending and last descending, as in Spark's default. The rows are
    written once, in order, below the shared folder; the numbers are added where they are read.
    """
    direction = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    keys = [*[F.col(c).asc() for c in within], *direction]
    ordered = df.repartitionByRange(ranges or range_count(df), *keys).sortWithinPartitions(*keys)
    written = materialize(ordered.withColumn("__place", F.monotonically_increasing_id()), "ranges")
    # the upper bits of a place are its range, the lower ones count from 0
    placed = written.withColumns({"__range": F.shiftright("__place", 33), "__at": F.col("__place").bitwiseAND((1 << 33) - 1)})
    sizes = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))  # one row per range
    columns = [F.col(f"`{c}`") for c in df.columns]
    if not within:
        return placed.join(starts, "__range").select(*columns, (F.col("__start") + F.col("__at") + 1).alias(name))
    # The group is one struct: structs with null fields are equal, so nulls need no null-safe join.
    placed = placed.withColumn("__group", F.struct(*[F.col(c) for c in within]))
    firsts = placed.groupBy("__range", "__group").agg(F.min("__at").alias("__first")).join(starts, "__range")
    first = F.min(F.col("__start") + F.col("__first")).over(Window.partitionBy("__group"))
    bases = firsts.select("__range", "__group", (F.col("__start") - first).alias("__base"))  # one row per group and range
    numbered = placed.join(bases.hint("merge"), ["__range", "__group"])  # bases grow with the groups: no broadcast
    return numbered.select(*columns, (F.col("__base") + F.col("__at") + 1).alias(name))


def running_totals(df: DataFrame, value: str, order: Sequence[str], within: Sequence[str] = (), name: str = "before", ranges: int | None = None) -> DataFrame:
    """Adds the sum of ``value`` over the rows that come earlier in their group, without a task that holds a whole group.

    ``order`` must end in a column that is unique in the group. A range of the sort order is summed by itself; the sums of a group's earlier
    ranges, one number for each group and range, are added.
    """
    keys = [F.col(c).asc() for c in (*within, *order)]
    ordered = df.repartitionByRange(ranges or range_count(df), *keys).withColumn("__range", F.spark_partition_id())
    placed = materialize(ordered.withColumn("__group", F.struct(F.lit(0).alias("__all"), *[F.col(c) for c in within])), "totals")
    sums = placed.groupBy("__group", "__range").agg(F.sum(value).alias("__sum"))
    earlier = Window.partitionBy("__group").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("__group", "__range", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__group", "__range").orderBy(*[F.col(c).asc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    columns = [F.col(f"`{c}`") for c in df.columns]
    summed = summed.join(bases.hint("merge"), ["__group", "__range"])  # bases grow with the groups: no broadcast
    return summed.select(*columns, (F.col("__base") + F.col("__inside")).alias(name))


def column_order(column: str, descending: bool = False) -> Column:
    """Nulls last ascending, nulls first descending."""
    return F.col(column).desc_nulls_first() if descending else F.col(column).asc_nulls_last()


def sort_by(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Stable sort: equal values keep their input order, which also lets a frequent value span several tasks."""
    placed = df.withColumn("__place", F.monotonically_increasing_id())
    return placed.orderBy(column_order(column, descending), "__place").drop("__place")


def top_n(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def page(df: DataFrame, order: Sequence[str], offset: int, size: int, descending: bool = False) -> DataFrame:
    """Rows ``offset+1 … offset+size`` of the sort order, which must end in a unique column, in that order.

    Near pages are a bounded top-n: every task keeps the first ``offset + size`` rows. For pages behind ``NEAR_ROWS`` the sort columns alone are
    numbered, and the page's keys are joined with the rows they stand for. To page on and on, keep the order (:mod:`.kept`).
    """
    if offset + size <= NEAR_ROWS:
        return df.orderBy(*[F.col(c).desc() if descending else F.col(c).asc() for c in order]).offset(offset).limit(size)
    numbered = number_rows(df.select(*order), order, descending=descending, name="__rn")
    wanted = numbered.where(F.col("__rn").between(offset + 1, offset + size)).select(F.struct(*order).alias("__key"), "__rn")
    rows = df.withColumn("__key", F.struct(*order)).join(wanted, "__key")
    return rows.orderBy("__rn").select(*[F.col(f"`{c}`") for c in df.columns])


def _column_facts(df: DataFrame) -> dict[str, dict]:
    """Of each column: type, whether it has values, whether its values look like dates, and like whole numbers. One pass."""
    facts, sums = {}, []
    for i, field in enumerate(df.schema.fields):
        column, kind = F.col(f"`{field.name}`"), field.dataType
        temporal, whole = isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)), isinstance(kind, T.IntegralType)
        facts[field.name] = {"temporal": temporal, "whole": whole, "number": whole or isinstance(kind, T.FractionalType), "text": isinstance(kind, T.StringType)}
        sums.append(F.count(column).alias(f"n{i}"))
        if facts[field.name]["number"]:
            sums += [F.min(column).cast("double").alias(f"low{i}"), F.max(column).cast("double").alias(f"high{i}")]
        elif facts[field.name]["text"]:
            sums += [F.count_if(column.rlike(DATE_TEXT)).alias(f"dates{i}"), F.count_if(column.rlike(r"^\d+$")).alias(f"digits{i}")]
    row = df.agg(*sums).first() if sums else {}
    for i, fact in enumerate(facts.values()):
        n = fact["n"] = row[f"n{i}"]
        if fact["number"]:
            dates = n > 0 and any(low < row[f"low{i}"] and row[f"high{i}"] < high for low, high in EPOCH_RANGES)
            fact |= {"dates": dates, "digits": fact["whole"] and n > 0}
        elif fact["text"]:
            fact |= {"dates": 2 * row[f"dates{i}"] > n, "digits": n > 0 and row[f"digits{i}"] == n}
        else:
            fact |= {"dates": fact["temporal"] and n > 0, "digits": False}
    return facts


def auto_sort_column(df: DataFrame) -> str | None:
    """Column to sort newest first: a date-like name with values, else a column of dates, else an id-like name of whole numbers.

    Decided by the schema and by aggregates over all rows: a number is a date if all values lie in one epoch range, a text if
    more than half of the values begin like one.
    """
    facts = _column_facts(df)

    def named(patterns: Sequence[str], test) -> str | None:
        found = (n for p in patterns for n, fact in facts.items() if re.search(p, n, re.IGNORECASE) and test(fact))
        return next(found, None)

    dated = next((n for n, fact in facts.items() if fact["dates"]), None)
    return named(DATE_NAMES, lambda f: f["n"] > 0) or dated or named(ID_NAMES, lambda f: f["digits"])


def auto_sort(df: DataFrame) -> DataFrame:
    column = auto_sort_column(df)
    return df if column is None else sort_by(df, column, descending=True)
