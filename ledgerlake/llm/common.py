"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.session import materialize, scratch_path

__all__ = ["materialize", "scratch_path", "map_batches", "has_columns", "fresh", "read_table", "ascii_lower", "ROW_CHUNK", "chunks", "slices", "ship_package", "sum_arrays"]

#: Rows handled together inside a task; long texts make the chunk end earlier (see :func:`chunks`).
ROW_CHUNK = 1000
CHUNK_CHARS = 2_000_000
#: So many tasks' arrays are added by the driver, one after another.
FEW_TASKS = 4

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(column):
    """Lower-case A-Z only; every other character stays as it is."""
    return F.translate(column, _UPPER, _UPPER.lower())


def has_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def fresh(df: DataFrame, name: str) -> str:
    """The name, or a longer one if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ship_package(spark: SparkSession) -> None:
    """Give the package's source to all Python workers, once per context: they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_ledgerlake_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = os.path.join(tempfile.mkdtemp(prefix="ledgerlake-source-"), f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(archive)
    context._ledgerlake_shipped = True


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow``: Spark splits the rows, each task streams its batches."""
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)


def slices(texts: list[str], chars: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of runs of at most ``ROW_CHUNK`` texts and about ``chars`` characters; a longer text is a run of its own."""
    start = size = 0
    for i, value in enumerate(texts):
        if i > start and (size + len(value) > chars or i - start >= ROW_CHUNK):
            yield start, i
            start, size = i, 0
        size += len(value)
    if start < len(texts):
        yield start, len(texts)


def chunks(batches: Iterator[pa.RecordBatch], text: str, chars: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with their texts (null: empty), bounded as in :func:`slices`."""
    for batch in batches:
        texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
        for start, end in slices(texts, chars):
            yield batch.slice(start, end - start), texts[start:end]


def sum_arrays(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None]) -> np.ndarray | None:
    """Sum of one float64 array per task, or None if no task has one.

    The tasks' arrays meet in about the square root of their number of groups first, so neither a group nor the driver holds more
    than that many arrays. A few go to the driver as they are.
    """
    tasks = df.rdd.getNumPartitions()
    groups = max(1, int(tasks**0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = function(batches)
        if made is not None:
            group = pa.array([TaskContext.get().partitionId() % groups], pa.int32())
            yield pa.RecordBatch.from_arrays([group, pa.array([made.astype(np.float64).tobytes()], pa.binary())], names=["g", "sums"])

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"sums": [sum(np.frombuffer(b) for b in rows["sums"]).tobytes()]})

    made = map_batches(df, run, "g int, sums binary")
    if tasks <= FEW_TASKS:
        total = None
        for row in made.toLocalIterator():
            part = np.frombuffer(row["sums"])
            total = part.copy() if total is None else np.add(total, part, out=total)
        return total
    parts = made.groupBy("g").applyInPandas(added, "sums binary").collect()
    return sum(np.frombuffer(r["sums"]) for r in parts) if parts else None
