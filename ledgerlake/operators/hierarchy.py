"""Self-referencing tables, closed by pointer doubling.

Each round replaces a row's pointer by its pointer's pointer, so a chain of length n takes log2(n) joins where a
level-by-level recursion takes n. Rows that are done leave the probing side. A row in, or below, a circle is never
done; after log2(rows) + 1 rounds only such rows are left.

Subtrees are ranges of a numbering, parents before their children: a row lies below another if its number lies in the other's range.
So the closure, whose size may be quadratic, is never written.

Both sides of a join here grow with the rows. They are small as compressed files and would be broadcast, through the driver, in every round;
the hint has them shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.operators.guards import one_per_key
from ledgerlake.operators.ranking import running_totals
from ledgerlake.session import materialize, materialize_counted

#: Stretches of the numbering in which ranges and rows meet.
STRETCHES = 1024


def _links(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """``id, up``: parents that do not exist count as no parent. A key that stands in two rows is an error."""
    known = nodes.select(F.col(key).alias("__known")).distinct()
    links = one_per_key(nodes.select(F.col(key).alias("id"), F.col(parent).alias("up")), ["id"])
    joined = links.join(known.hint("merge"), links["up"] == known["__known"], "left")
    return joined.select("id", F.col("__known").alias("up"))


def _rounds(rows: int) -> int:
    return max(math.ceil(math.log2(rows + 1)), 1) + 1


def roots_and_depths(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """Root and depth of each row. A row that reaches no root, because of a circle, has null for both."""
    links = _links(nodes, key, parent).select(
        "id",
        F.coalesce("up", "id").alias("root"),
        F.when(F.col("up").isNull(), 0).otherwise(1).cast("bigint").alias("depth"),
        F.col("up").isNull().alias("done"),
    )
    done, waiting, seen = _split(links, F.col("done"))
    for _ in range(_rounds(seen["rows"])):
        if not seen["waiting"]:
            break
        step = done.unionByName(waiting)
        step = step.select(F.col("id").alias("root"), F.col("root").alias("r"), F.col("depth").alias("d"), "done")
        moved = waiting.drop("done").join(step.hint("merge"), "root")
        moved = moved.select("id", F.col("r").alias("root"), (F.col("depth") + F.col("d")).alias("depth"), "done")
        finished, waiting, seen = _split(moved, F.col("done"))
        done = done.unionByName(finished)
    lost = waiting.select("id", *[F.lit(None).cast(waiting.schema[c].dataType).alias(c) for c in ("root", "depth")])
    found = done.select("id", "root", "depth").unionByName(lost)
    return found.withColumnRenamed("id", key)


def mark_descendants(nodes: DataFrame, key: str, parent: str, seeds: DataFrame) -> DataFrame:
    """The seed rows and every row below one of them; circles are safe."""
    seed = seeds.select(F.col(seeds.columns[0]).alias("id")).distinct().withColumn("__seed", F.lit(True))
    links = _links(nodes, key, parent).join(seed.hint("merge"), "id", "left")
    links = links.select("id", "up", F.coalesce("__seed", F.lit(False)).alias("hit"))
    settled = F.col("hit") | F.col("up").isNull()
    done, waiting, seen = _split(links, settled)
    for _ in range(_rounds(seen["rows"])):
        if not seen["waiting"]:
            break
        step = done.unionByName(waiting)
        step = step.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("hit").alias("above"))
        moved = waiting.drop("hit").join(step.hint("merge"), "up").select("id", F.col("next").alias("up"), F.col("above").alias("hit"))
        finished, waiting, seen = _split(moved, settled)
        done = done.unionByName(finished)
    return done.where("hit").select(F.col("id").alias(key))


def subtree_ranges(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """``key, root, depth, first, last``: a row's number in the forest and the last number below it.

    Numbers count from 0; a parent comes right before its children, roots and siblings in the order of their keys. A row whose parent does
    not exist is a root. A row in, or below, a circle has null for all but its key. Sizes of subtrees and sums along paths take log2(depth)
    rounds each; sums over siblings hold for a parent with any number of children.
    """
    placed = materialize(roots_and_depths(nodes, key, parent).withColumnRenamed(key, "id"), "forest")
    reached = placed.where(F.col("root").isNotNull())
    links = materialize(_links(nodes, key, parent).join(reached.select("id").hint("merge"), "id", "left_semi").select("id", "up"), "forest-links")
    rounds = int(reached.agg(F.max("depth")).first()[0] or 0).bit_length()

    sizes = links.select("id", F.col("up").alias("jump"), F.lit(1).cast("bigint").alias("size"))
    for _ in range(rounds):  # size: rows below at a distance of less than 2 ** round; jump: the ancestor at that distance
        sent = sizes.where(F.col("jump").isNotNull()).groupBy(F.col("jump").alias("id")).agg(F.sum("size").alias("more"))
        moved = _jumped(sizes, "size", F.col("size")).join(sent.hint("merge"), "id", "left")
        sizes = materialize(moved.select("id", "jump", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), "subtree-sizes")
    # written, as the number of ranges follows from the size of the rows, which for a join is a guess
    sized = materialize(links.join(sizes.select("id", "size").hint("merge"), "id"), "subtree-sized")

    before = running_totals(sized, "size", ["id"], within=["up"], name="before")
    own = F.col("before") + F.when(F.col("up").isNull(), 0).otherwise(1)
    steps = materialize(before.select("id", F.col("up").alias("jump"), own.cast("bigint").alias("first"), "size"), "sibling-steps")
    paths = steps.select("id", "jump", "first")
    for _ in range(rounds):
        paths = materialize(_jumped(paths, "first", F.col("first") + F.col("above")), "path-sums")

    numbered = paths.select("id", "first").join(steps.select("id", "size").hint("merge"), "id")
    ranges = numbered.select("id", "first", (F.col("first") + F.col("size") - 1).alias("last"))
    return placed.join(ranges.hint("merge"), "id", "left").select(F.col("id").alias(key), "root", "depth", "first", "last")


def _jumped(state: DataFrame, value: str, combined: Column) -> DataFrame:
    """``id, jump, value`` after one doubling; ``combined`` may use ``above``, the value of the row jumped to."""
    onward = state.select(F.col("id").alias("jump"), F.col("jump").alias("next"), F.col(value).alias("above"))
    waiting = state.where(F.col("jump").isNotNull()).join(onward.hint("merge"), "jump")
    return state.where(F.col("jump").isNull()).unionByName(waiting.select("id", F.col("next").alias("jump"), combined.alias(value)))


def descendants(ranges: DataFrame, key: str, seeds: DataFrame) -> DataFrame:
    """``ancestor, key, distance`` of every row below a seed (first column of ``seeds``), from the result of :func:`subtree_ranges`.

    Seeds and rows meet in stretches of the numbering and are compared there; a seed stands in each stretch that its range touches. Seeds that
    are no row, or in a circle, have no rows below.
    """
    seed = seeds.select(F.col(seeds.columns[0]).alias("ancestor")).distinct()
    known = ranges.where(F.col("first").isNotNull()).select(F.col(key).alias("id"), "depth", "first", "last")
    width = F.greatest(F.ceil((known.agg(F.max("first")).scalar() + 1) / STRETCHES), F.lit(1))
    wanted = seed.join(known.hint("merge"), seed["ancestor"] == known["id"]).where("last > first")
    wanted = wanted.select("ancestor", F.col("depth").alias("from"), F.col("first").alias("low"), "last", width.alias("width"))
    touched = F.sequence(F.floor(F.col("low") / F.col("width")), F.floor(F.col("last") / F.col("width")))
    wanted = wanted.withColumn("stretch", F.explode(touched)).drop("width")
    rows = known.select("id", "depth", "first", F.floor(F.col("first") / width).alias("stretch"))
    met = rows.join(wanted.hint("merge"), "stretch").where("first > low AND first <= last")
    return met.select("ancestor", F.col("id").alias(key), (F.col("depth") - F.col("from")).alias("distance"))


def _split(state: DataFrame, settled: Column) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Settled and waiting rows, written and counted in one job; settled rows are not written again in later rounds."""
    written, seen = materialize_counted(state, "closure", rows=F.count(F.lit(1)), waiting=F.count_if(~settled))
    return written.where(settled), written.where(~settled), seen
