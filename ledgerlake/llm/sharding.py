"""Shards of nearly equal bytes by Karmarkar-Karp differencing; equal texts stay together.

A partial partition is ``k`` sums. The two with the largest spread are combined again and again, the largest sum of one with the
smallest of the other, until one is left. Groups are differenced in blocks inside the tasks; the blocks' partial partitions are
combined by the same rule, so what reaches the driver is ``k`` sums for each block and never a group.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlake.llm.common import has_columns, map_batches, materialize, ship_package

#: Groups differenced together in a task: about 100 MB.
BLOCK = 100_000
#: Partial partitions combined at once, by the driver or by one task.
MOST_UNITS = 2048
#: Rows numbered together.
RUN = 256
LAW = "bytes"


def difference(units: Sequence[Sequence[int]], k: int) -> list[list[int]]:
    """Bin of every sum: ``result[u][j]`` is the bin of ``units[u][j]``; the sums of one unit go to different bins.

    A unit of one number is a group: it is a partial partition with ``k - 1`` empty sums. Ties are broken by position, so equal
    input gives equal output.
    """
    # a bin is a leaf (unit, position) or a pair of bins; None is empty
    heap = []
    for u, sums in enumerate(units):
        filled = sorted((s, (u, j)) for j, s in enumerate(sums))
        if len(filled) > k:
            raise ValueError(f"a unit has more than {k} sums")
        values = [0] * (k - len(filled)) + [s for s, _ in filled]
        heap.append((values[0] - values[-1], u, values, [None] * (k - len(filled)) + [leaf for _, leaf in filled]))
    heapq.heapify(heap)
    turn = len(units)
    while len(heap) > 1:
        _, _, left, left_bins = heapq.heappop(heap)
        _, _, right, right_bins = heapq.heappop(heap)
        right.reverse()
        right_bins.reverse()
        sums = list(map(int.__add__, left, right))
        order = sorted(range(k), key=sums.__getitem__)
        bins = [left_bins[i] if right_bins[i] is None else right_bins[i] if left_bins[i] is None else [left_bins[i], right_bins[i]] for i in order]
        sums = [sums[i] for i in order]
        heapq.heappush(heap, (sums[0] - sums[-1], turn, sums, bins))
        turn += 1
    result = [[0] * len(sums) for sums in units]
    for number, tree in enumerate(heap[0][3] if heap else []):
        stack = [] if tree is None else [tree]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack.extend(node)
            else:
                result[node[0]][node[1]] = number
    return result


def _difference_groups(groups: DataFrame, k: int) -> DataFrame:
    """``key, bytes, unit, local``: blocks of groups differenced where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            sizes = table.column("bytes").to_pylist()
            local = [row[0] for row in difference([(s,) for s in sizes], k)]
            units = pa.array([(part << 24) + number] * len(sizes), pa.int64())
            return pa.RecordBatch.from_arrays(
                [table.column("key").combine_chunks(), table.column("bytes").combine_chunks(), units, pa.array(local, pa.int32())],
                names=["key", "bytes", "unit", "local"],
            )

        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(start, BLOCK)
                if held and size + piece.num_rows > BLOCK:
                    yield flush()
                    held, size, number = [], 0, number + 1
                held.append(piece)
                size += piece.num_rows
        if held:
            yield flush()

    return map_batches(groups.select("key", "bytes"), run, "key binary, bytes long, unit long, local int")


def _combine(sums: DataFrame, k: int) -> DataFrame:
    """``unit, local, shard`` from ``unit, local, bytes``. More units than one place should hold are combined in levels."""
    spark = sums.sparkSession
    units = sums.select("unit").distinct().count()

    def mapped(rows: pd.DataFrame) -> pd.DataFrame:
        wide = rows.sort_values(["unit", "local"])
        keys = [(u, part["local"].tolist(), part["bytes"].tolist()) for u, part in wide.groupby("unit", sort=True)]
        bins = difference([b for _, _, b in keys], k)
        out = [(u, j, s, b) for (u, local, sizes), row in zip(keys, bins) for j, s, b in zip(local, sizes, row)]
        return pd.DataFrame(out, columns=["unit", "local", "bytes", "shard"])

    if units <= MOST_UNITS:
        rows = sums.select("unit", "local", "bytes").toPandas()  # at most MOST_UNITS * k rows
        made = mapped(rows) if len(rows) else pd.DataFrame(columns=["unit", "local", "bytes", "shard"])
        return spark.createDataFrame(
            [(int(u), int(j), int(s)) for u, j, s in zip(made["unit"], made["local"], made["shard"])], "unit long, local int, shard int"
        )
    ship_package(spark)
    above = F.pmod(F.xxhash64("unit"), F.lit(-(-2 * units // MOST_UNITS)))
    level = sums.withColumn("above", above).groupBy("above").applyInPandas(
        lambda rows: mapped(rows).assign(above=rows["above"].iloc[0]), "unit long, local int, bytes long, shard int, above long"
    )
    level = materialize(level, "shard-level")
    upper = level.groupBy(F.col("above").alias("unit"), F.col("shard").alias("local")).agg(F.sum("bytes").alias("bytes"))
    upper = _combine(materialize(upper, "shard-sums"), k).withColumnsRenamed({"unit": "above", "local": "inner", "shard": "to"})
    return level.withColumnRenamed("shard", "inner").join(upper, ["above", "inner"]).select("unit", "local", F.col("to").alias("shard"))


def text_key(text: str = "text"):
    """128 bits that stand for a whole text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))))


def shard_groups(rows: DataFrame, shards: int) -> DataFrame:
    """``key, shard`` for every key of ``rows`` (``key``, ``size``): the bytes of a key are indivisible."""
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    local = materialize(_difference_groups(groups, shards), "shard-blocks")
    sums = materialize(local.groupBy("unit", "local").agg(F.sum("bytes").alias("bytes")), "shard-sums")
    return materialize(local.join(_combine(sums, shards), ["unit", "local"]).select("key", "shard"), "shard-groups")


def shard_documents(df: DataFrame, shards: int = 16, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row per row: id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    Size is the text's UTF-8 bytes plus one (null: one, and null counts as the empty text). Equal texts share a shard, so a group
    larger than its share makes its shard that large, and the others are balanced around it. Slots are gapless from 0 in every
    shard, in no given order. ``grown_shard`` is null: another number of shards means another balance. Ids may be null or
    repeated; each row has its own slot. An empty table gives an empty result.

    Only ids, sizes and 16-byte keys are shuffled, never texts. A hot group is summed per task before the shuffle, and the join
    that brings its rows their shard has an exchange on both sides, which Spark splits.
    """
    has_columns(df, id_column, text)
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = df.select(
        F.col(f"`{id_column}`").alias("id"),
        (F.octet_length(content).cast("long") + 1).alias("size"),
        F.crc32(F.encode(content, "UTF-8")).alias("crc"),
        text_key(text).alias("key"),
    )
    rows = materialize(rows, "shard-rows")
    placed = rows.join(shard_groups(rows, shards), "key").select("id", "size", "crc", "shard", F.monotonically_increasing_id().alias("row"))
    # the row numbers are fixed by writing them; part and run of a row follow from its number
    placed = materialize(placed, "shard-placed").withColumn("part", F.shiftright("row", 33)).withColumn("run", F.floor(F.col("row") / RUN))
    numbered = placed.withColumn("n", F.row_number().over(Window.partitionBy("run", "shard").orderBy("row")) - 1)
    runs = materialize(placed.groupBy("part", "run", "shard").agg(F.count("*").alias("rows")), "shard-runs")
    before = Window.partitionBy("part", "shard").orderBy("run")
    parts = runs.groupBy("part", "shard").agg(F.sum("rows").alias("rows"))
    parts = parts.select("part", "shard", (F.sum("rows").over(Window.partitionBy("shard").orderBy("part")) - F.col("rows")).alias("base"))
    starts = runs.withColumn("inside", F.sum("rows").over(before) - F.col("rows")).join(parts, ["part", "shard"])
    starts = materialize(starts.select("run", "shard", (F.col("inside") + F.col("base")).alias("start")), "shard-starts")
    return numbered.join(starts, ["run", "shard"]).select(
        F.col("id").alias(id_column),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit(LAW).alias("law"),
        "shard",
        (F.col("start") + F.col("n")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(df: DataFrame, path: str, shards: int = 16, text: str = "text") -> None:
    """Write whole rows below ``path``, one folder per shard (column ``shard``, which must not be taken). A task writes its rows
    of each shard as a file, so no shard passes through one task."""
    if "shard" in [c.lower() for c in df.columns]:
        raise ValueError("the column shard is taken")
    keyed = df.withColumn("_key", text_key(text))
    sizes = keyed.select(F.col("_key").alias("key"), (F.octet_length(F.coalesce(F.col(f"`{text}`"), F.lit(""))).cast("long") + 1).alias("size"))
    groups = shard_groups(sizes, shards).withColumnRenamed("key", "_key")
    keyed.join(groups, "_key").drop("_key").write.partitionBy("shard").parquet(path)
