"""A kept sort order: the sorted rows in files, and an index with the first key, last key and number of rows of each file.

A page, or the rows from a key on, opens only the files it touches, however deep it lies; paging on sorts nothing again.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ledgerlake.operators.ranking import range_count

#: Rows of a file, at most: a page reads one or two files.
FILE_ROWS = 250_000


@dataclass(frozen=True)
class KeptOrder:
    spark: SparkSession
    path: str
    schema: StructType
    order: list[str]
    descending: bool
    rows: int

    def _sorting(self) -> list[Column]:
        return [F.col(f"`{c}`").desc() if self.descending else F.col(f"`{c}`").asc() for c in self.order]

    def index(self) -> DataFrame:
        """``file, start, rows, first_key, last_key`` of each file; ``start`` counts the rows of earlier files."""
        return self.spark.read.parquet(f"{self.path}/index")

    def _files(self, wanted: DataFrame) -> DataFrame:
        names = [f"{self.path}/rows/{r['file']}" for r in wanted.collect()]
        return self.spark.read.schema(self.schema).parquet(*names) if names else self.spark.createDataFrame([], self.schema)

    def page(self, offset: int, size: int) -> DataFrame:
        """Rows ``offset+1 … offset+size``, in order."""
        wanted = self.index().where((F.col("start") < offset + size) & (F.col("start") + F.col("rows") > offset))
        first = wanted.agg(F.min("start")).first()[0]
        rows = self._files(wanted).orderBy(*self._sorting())
        return rows.offset(offset - first if first is not None else 0).limit(size)

    def page_after(self, key: Sequence, size: int) -> DataFrame:
        """The ``size`` rows that follow a key (values of the order's columns, none null), in order."""
        after = self._after([F.col(f"`{c}`") for c in self.order], key)
        last = self._after([F.col("last_key")[c] for c in self.order], key)
        later = self.index().where(last)
        # files from the first that reaches beyond the key, until they hold enough rows after it
        start = later.agg(F.min("start")).first()[0]
        if start is None:
            return self.spark.createDataFrame([], self.schema)
        before = Window.partitionBy(F.lit(0)).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
        wanted = later.withColumn("sure", F.sum(F.when(F.col("start") > start, F.col("rows")).otherwise(0)).over(before))
        wanted = wanted.where(F.coalesce("sure", F.lit(0)) < size)
        return self._files(wanted).where(after).orderBy(*self._sorting()).limit(size)

    def _after(self, columns: list[Column], key: Sequence) -> Column:
        """Whether a row comes after the key; Spark's order of nulls: first ascending, last descending."""
        tests, equal = [], F.lit(True)
        for column, value in zip(columns, key):
            later = (column.isNull() | (column < F.lit(value))) if self.descending else (column.isNotNull() & (column > F.lit(value)))
            tests.append(equal & F.coalesce(later, F.lit(False)))
            equal = equal & F.coalesce(column == F.lit(value), F.lit(False))
        return reduce(or_, tests)


def keep_order(df: DataFrame, order: Sequence[str], path: str, descending: bool = False, file_rows: int = FILE_ROWS) -> KeptOrder:
    """Sort the rows once and write them below ``path``; ``order`` must end in a unique column.

    Ranges of the order are sorted by as many tasks as the rows ask for. The index is made from the order's columns alone.
    """
    spark = df.sparkSession
    keys = [F.col(f"`{c}`").desc() if descending else F.col(f"`{c}`").asc() for c in order]
    ordered = df.repartitionByRange(range_count(df), *keys).sortWithinPartitions(*keys)
    ordered.write.option("maxRecordsPerFile", file_rows).parquet(f"{path}/rows")
    written = spark.read.schema(df.schema).parquet(f"{path}/rows")
    key = F.struct(*[F.col(f"`{c}`") for c in order])
    ends = (F.max(key), F.min(key)) if descending else (F.min(key), F.max(key))
    files = written.select(F.col("_metadata.file_name").alias("file"), *[F.col(f"`{c}`") for c in order])
    files = files.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), ends[0].alias("first_key"), ends[1].alias("last_key"))
    # one row per file; a task's files and their parts are numbered in order
    earlier = Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    index = files.withColumn("start", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    index.select("file", "start", "rows", "first_key", "last_key").write.parquet(f"{path}/index")
    count = spark.read.parquet(f"{path}/index").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    about = json.dumps({"schema": df.schema.json(), "order": list(order), "descending": descending, "rows": count})
    spark.createDataFrame([(about,)], "value STRING").coalesce(1).write.text(f"{path}/about")
    return KeptOrder(spark, path, df.schema, list(order), descending, count)


def open_order(spark: SparkSession, path: str) -> KeptOrder:
    """An order that was kept before, in this session or another."""
    about = json.loads(spark.read.text(f"{path}/about").first()["value"])
    return KeptOrder(spark, path, StructType.fromJson(json.loads(about["schema"])), about["order"], about["descending"], about["rows"])
