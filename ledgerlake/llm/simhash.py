"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``2 r`` bits have a common variant within ``r`` bits of both. So every distinct
fingerprint emits all its variants within half the radius, the variants are shuffled, and fingerprints that meet are verified
and linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlake.llm.common import chunks, fresh, has_columns, map_batches, materialize
from ledgerlake.llm.components import connected_components

BITS = 64
SEED = 42
#: Shingles whose bits are counted together: 13 MB, whatever the length of the text.
COUNTED_TOGETHER = 200_000


def simhash(text: str, words: int = 3) -> int:
    """Signed 64-bit fingerprint of a whole text. A bit is set if it is set in over half of the shingles' hashes."""
    import xxhash

    digest = xxhash.xxh64_digest
    found = text.encode("utf-8").lower().split()  # of bytes: A-Z, and the six ASCII white space characters
    if not found:
        return 0
    if len(found) < words:
        return int.from_bytes(digest(b" ".join(found), SEED), "big", signed=True)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist()
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(first), COUNTED_TOGETHER):
        block = b"".join([digest(joined[s:e], SEED) for s, e in zip(first[i : i + COUNTED_TOGETHER], last[i : i + COUNTED_TOGETHER])])
        counts += np.unpackbits(np.frombuffer(block, dtype=np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(first)).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, text: str = "text", id_column: str = "doc_id", words: int = 3) -> DataFrame:
    """``doc_id`` (as named) and ``fp``, one row per row. Null and empty texts and texts without a word have ``fp`` zero."""
    has_columns(df, id_column, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([simhash(t, words) for t in texts], pa.int64())], names=["id", "fp"])

    kind = df.schema[id_column].dataType.simpleString()
    made = map_batches(df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text")), run, f"id {kind}, fp long")
    return made.withColumnRenamed("id", id_column)


def _masks(radius: int) -> list[int]:
    """Every pattern of at most ``radius`` set bits, as signed longs."""
    patterns = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(BITS), n)]
    return [p - (1 << BITS) if p >= 1 << (BITS - 1) else p for p in patterns]


def linked_fingerprints(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """Pairs ``a > b`` that join all fingerprints (column ``fp``, distinct) at ``distance`` or fewer bits into components.

    Fingerprints that meet in a variant are within ``2 * (distance // 2 + distance % 2)`` bits of each other; each is compared
    with the smallest of its variant and verified. With an even distance that check always holds, and as all in the ball of a
    variant are linked, the star has the same components as all pairs; a ball holds at most 65 fingerprints at distance 2. With an odd
    distance the star could miss links, so only even distances are taken.
    """
    if distance % 2 or not 0 < distance <= 4:
        raise ValueError("the distance must be 2 or 4")
    masks = _masks(distance // 2)
    if len(masks) <= 100:
        variants = F.array(*[F.col("fp").bitwiseXOR(F.lit(m)) for m in masks])
    else:
        variants = F.transform(F.lit(masks), lambda m: F.col("fp").bitwiseXOR(m))
    emitted = distinct.select("fp", F.explode(variants).alias("variant"))
    ball = Window.partitionBy("variant")
    met = emitted.withColumn("b", F.min("fp").over(ball)).where("fp > b")
    return (
        met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= distance)
        .select(F.col("fp").alias("a"), "b")
        .distinct()
    )


def _first_of_fingerprints(prints: DataFrame, distance: int, id_column: str) -> DataFrame:
    """``fp, component_id, component_fp`` of every distinct fingerprint."""
    distinct = materialize(prints.groupBy("fp").agg(F.min(id_column).alias("first_id")), "fingerprints")
    roots = materialize(connected_components(linked_fingerprints(distinct.select("fp"), distance)), "fingerprint-roots")
    firsts = distinct.join(roots, distinct["fp"] == roots["node"]).groupBy("root").agg(F.min("first_id").alias("component_first"))
    firsts = materialize(firsts, "component-firsts")
    linked = materialize(roots.join(firsts, "root"), "fingerprint-components")
    named = distinct.join(linked, distinct["fp"] == linked["node"], "left")
    own = F.col("node").isNull()
    return materialize(
        named.select(
            "fp",
            F.when(own, F.col("first_id")).otherwise(F.col("component_first")).alias("component_id"),
            F.coalesce("root", "fp").alias("component_fp"),
        ),
        "fingerprint-classes",
    )


def near_duplicate_classes(df: DataFrame, text: str = "text", id_column: str = "doc_id", distance: int = 2) -> DataFrame:
    """One row per row of ``df``: id, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable over links.

    Copies are collapsed to their fingerprint before any pairing, so a group of copies of any size is one row there. The last
    join meets copies with their class; both sides come straight from an exchange, so Spark splits a hot fingerprint. Null and
    empty texts share fingerprint zero and are linked like any other. Null ids never become a ``component_id`` unless the
    component has no other. Repeated rows stay; an empty table gives an empty result.
    """
    prints = materialize(fingerprints(df, text, id_column), "simhash")
    classes = _first_of_fingerprints(prints, distance, id_column)
    joined = prints.join(classes, "fp")
    return joined.select(id_column, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first_of_groups(df: DataFrame, text: str = "text", id_column: str = "doc_id", distance: int = 2) -> DataFrame:
    """The rows of ``df`` that have the smallest id of their component, with the columns of ``df``; one row for each component.

    Of repeated rows with that id (or of rows without any id, if the component has no other) one stays. Texts are shuffled once, to
    meet the kept ids. Other columns may have any name.
    """
    prints = materialize(fingerprints(df, text, id_column), "simhash")
    classes = _first_of_fingerprints(prints, distance, id_column)
    first = prints.join(classes, "fp").where(F.col(id_column).eqNullSafe(F.col("component_id")))
    kept = materialize(first.groupBy(F.col(id_column).alias("_id"), "component_fp").agg(F.count("*").alias("_n"), F.min("fp").alias("_fp")), "kept")
    # ids that stand once in one kept class: a plain semi join on the id
    once = kept.groupBy("_id").agg(F.sum("_n").alias("_rows")).where("_rows = 1 AND _id IS NOT NULL")
    rows = prints.groupBy(F.col(id_column).alias("_id")).agg(F.count("*").alias("_all"))
    alone = materialize(once.join(rows, "_id").where("_all = 1").select("_id"), "kept-ids")
    # texts move once at every size: the kept ids grow with the documents and are never broadcast
    own = fresh(df, "_id")
    plain = df.join(alone.withColumnRenamed("_id", own).hint("merge"), F.col(f"`{id_column}`") == F.col(own), "left_semi")
    # the rest: ids that several rows carry, and rows without an id; these few are told apart by their fingerprint
    rest = materialize(kept.join(alone, kept["_id"].eqNullSafe(alone["_id"]), "left_anti").select("_id", "component_fp"), "kept-repeated")
    if rest.isEmpty():
        return plain
    members = classes.select("fp", "component_fp").join(rest, "component_fp").select("fp", "_id", "component_fp")
    members = materialize(members.withColumnsRenamed({"fp": "_fp", "component_fp": "_class"}), "kept-members")
    ids = materialize(rest.select("_id").distinct(), "repeated-ids")
    doubtful = df.join(ids.withColumnRenamed("_id", own), F.col(f"`{id_column}`").eqNullSafe(F.col(own)), "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    doubtful = materialize(doubtful.select(F.monotonically_increasing_id().alias("_row"), F.col(f"`{id_column}`").alias("_of"), F.col(f"`{text}`").alias("_text"), row.alias("_value")), "repeated-rows")
    told = fingerprints(doubtful.select("_row", "_text"), "_text", "_row")
    chosen = (
        told.withColumnRenamed("fp", "_print")
        .join(doubtful.select("_row", "_of"), "_row")
        .join(members, (F.col("_print") == F.col("_fp")) & F.col("_of").eqNullSafe(F.col("_id")))
        .groupBy("_class")
        .agg(F.min("_row").alias("_row"))
    )
    return plain.unionByName(doubtful.join(chosen.select("_row"), "_row", "left_semi").select("_value.*"))
