"""Connected components of a graph given as pairs, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import materialize


def _signature(edges: DataFrame) -> tuple[int, int]:
    """Count and order-free sum of hashes of the pairs."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return int(row[0]), int(row[1] or 0)


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``edges`` (columns ``a``, ``b``): the root is the smallest node of its component.

    Repeated pairs, both directions of a pair and loops are allowed; pairs with a null are left out; no pairs give no rows.
    A round halves the depth at least, so their number grows with the logarithm of the longest path. Minima are taken per task
    before the shuffle, and each is written before it is joined, so that Spark can split the partition of a hub. All rounds live
    in the shared folder; the driver sees a count and a sum.
    """
    nodes = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    loops = nodes.where("a = b").select(F.col("a").alias("node")).distinct()
    links = nodes.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = materialize(links, "links")
    seen = _signature(current)
    while seen[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "large-star-minima")
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large-star")
        lowest = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "small-star-minima")
        small = large.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = materialize(small.unionByName(lowest.withColumnRenamed("m", "b")).distinct(), "small-star")
        now = _signature(current)
        if now == seen:
            break
        seen = now
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = current.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    known = stars.unionByName(roots)
    return known.unionByName(loops.join(known, "node", "left_anti").select("node", F.col("node").alias("root")))
