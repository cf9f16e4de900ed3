"""Document fingerprints from prefix polynomial hashes.

A text of code points ``c`` has the prefix array ``P[i] = sum of (c[j] + 1) * b**j for j < i``, modulo a Mersenne prime. Two entries
answer whether any two spans are equal, binary search over entries finds the longest common extension of two positions, and the
array of a text that is put together from two others follows from theirs. A fingerprint is the length, the hash of the whole text
under two bases and the smallest hashes of its spans of 12 characters, so likeness does not depend on where a span stands.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import has_columns, map_batches

PRIME = np.uint64(2**31 - 1)
BASES = (1_000_003, 777_767_777)
SPAN = 12
SKETCH = 64

#: Buckets of neighbouring documents: about this many rows each, as long as their bounds are few.
ROWS_IN_BUCKET = 1000
MOST_BUCKETS = 65_536
_SHIFT = np.uint64(31)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _reduce(x: np.ndarray) -> np.ndarray:
    """Remainders of numbers below 2**62."""
    x = (x & PRIME) + (x >> _SHIFT)
    x -= (x >= PRIME) * PRIME
    return x


class Powers:
    """Powers of a base and of its inverse, doubled when a longer text comes."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, int(PRIME))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> Powers:
        while len(self.up) < n:
            more = len(self.up)
            self.up = np.concatenate((self.up, _reduce(self.up * np.uint64(pow(self.base, more, int(PRIME))))))
            self.down = np.concatenate((self.down, _reduce(self.down * np.uint64(pow(self.inverse, more, int(PRIME))))))
        return self


class PrefixHash:
    """Prefix arrays of one text under both bases."""

    def __init__(self, arrays: list[np.ndarray], powers: list[Powers]):
        self.arrays, self.powers = arrays, powers
        self.n = len(arrays[0]) - 1

    @classmethod
    def of(cls, text: str, powers: list[Powers]) -> PrefixHash:
        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        arrays = []
        for power in powers:
            terms = _reduce(codes * power.reach(len(codes)).up[: len(codes)])
            sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(terms)))
            arrays.append(_reduce(sums))
        return cls(arrays, powers)

    def joined(self, keep: int, other: PrefixHash, take: int) -> PrefixHash:
        """The arrays of the first ``keep`` characters followed by the first ``take`` of another text, without reading either."""
        arrays = []
        for mine, theirs, power in zip(self.arrays, other.arrays, self.powers):
            scale = power.reach(keep + 1).up[keep]
            tail = _reduce(_reduce(theirs[1 : take + 1] * scale) + mine[keep])
            arrays.append(np.concatenate((mine[: keep + 1], tail)))
        return PrefixHash(arrays, self.powers)

    def span(self, start: int, end: int, b: int = 0) -> int:
        """Hash of a span, the same wherever it stands."""
        prime = int(PRIME)
        value = int(self.arrays[b][end]) - int(self.arrays[b][start])
        return value % prime * int(self.powers[b].reach(start + 1).down[start]) % prime

    def same(self, start: int, other: PrefixHash, at: int, length: int) -> bool:
        return all(self.span(start, start + length, b) == other.span(at, at + length, b) for b in range(len(self.arrays)))

    def extension(self, start: int, other: PrefixHash, at: int) -> int:
        """Length of the longest common extension of two positions, by binary search over span equality."""
        low, high = 0, min(self.n - start, other.n - at)
        while low < high:
            middle = (low + high + 1) // 2
            if self.same(start, other, at, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def spans(self, start: int = 0) -> np.ndarray:
        """Mixed 32-bit hashes of all spans of ``SPAN`` characters from ``start`` on; a shorter text is one span."""
        array, power = self.arrays[0], self.powers[0].reach(self.n + 1)
        width = min(SPAN, self.n)
        if not width:
            return np.zeros(0, dtype=np.uint32)
        count = self.n - width + 1
        values = _reduce((array[start + width :] + PRIME) - array[start:count])
        values = _reduce(values * power.down[start:count])
        return ((values * _MIX) >> np.uint64(32)).astype(np.uint32)

    def fingerprint(self, spans: np.ndarray) -> tuple[str, np.ndarray]:
        lowest = np.unique(spans)[:SKETCH]
        whole = "".join(f"{int(a[-1]):08x}" for a in self.arrays)
        return f"{self.n:x}-{whole}-{lowest.astype('>u4').tobytes().hex()}", lowest


def likeness(left: np.ndarray, right: np.ndarray) -> float:
    """Estimated share of common spans, twice the common ones over all of either (1: the same, or both empty).

    Of the smallest hashes of both sketches together, those in both estimate the common share ``j`` of the union; ``2 j / (1 + j)``.
    """
    both = np.union1d(left, right)[:SKETCH]
    if not len(both):
        return 1.0
    common = np.count_nonzero(np.isin(both, left, assume_unique=True) & np.isin(both, right, assume_unique=True)) / len(both)
    return float(2 * common / (1 + common))


def _order(value, h) -> tuple:
    return (value is not None, value if value is not None else 0, h)


def _bounds(keys: DataFrame, rows: int) -> list[tuple]:
    """Cut points between buckets from a sample; they decide balance only, never the result."""
    buckets = min(MOST_BUCKETS, max(1, -(-rows // ROWS_IN_BUCKET)))
    if buckets == 1:
        return []
    each = 40 if buckets <= 4096 else 10  # keys that reach the driver, about, for a bucket
    sample = keys.sample(min(1.0, each * buckets / rows), seed=7).collect()
    ordered = sorted({_order(r[0], r[1]) for r in sample})
    return sorted({ordered[i * len(ordered) // buckets] for i in range(1, buckets)}) if ordered else []


def neighbour_fingerprints(df: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row per row: id, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``,
    ``common_prefix_edited`` and ``common_prefix_next`` (characters of the longest common extension at the start).

    The next document is that of the next id, null ids first and equal ids by a hash of their texts; after the last comes the first.
    The edited text has its last quarter (floored) replaced by as many first characters of the next document, or all of them. Null
    texts are empty. Rows are never merged: a repeated row is the next of its twin. An empty table gives an empty result.

    Texts are shuffled once, into buckets of neighbouring ids, and streamed in order; a task holds two texts at a time. The first
    row of every bucket goes to the bucket before it as well. Only bounds and first keys of at most ``MOST_BUCKETS`` buckets reach the driver.
    """
    has_columns(df, id_column, text)
    kind = df.schema[id_column].dataType.simpleString()
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    source = df.select(F.col(f"`{id_column}`").alias("id"), F.xxhash64(content).alias("h"), content.alias("text"))
    keys = source.select("id", "h")
    bounds = _bounds(keys, df.select(id_column).count())

    def first_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[int, tuple] = {}
        for batch in batches:
            for value, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                key = _order(value, h)
                b = bisect_right(bounds, key)
                if b not in first or key < first[b]:
                    first[b] = key
        rows = [(b, k[1] if k[0] else None, k[2]) for b, k in first.items()]
        columns = list(zip(*rows)) if rows else [(), (), ()]
        types = (pa.int32(), schema_type, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["bucket", "id", "h"])

    from pyspark.sql.pandas.types import to_arrow_type

    schema_type = to_arrow_type(df.schema[id_column].dataType)
    found = map_batches(keys, first_keys, f"bucket int, id {kind}, h long")
    found = found.groupBy("bucket").agg(F.min_by(F.struct("id", "h"), F.struct(F.col("id").isNotNull(), "id", "h")).alias("k")).collect()
    firsts = {r["bucket"]: _order(r["k"]["id"], r["k"]["h"]) for r in found}
    filled = sorted(firsts)
    before = {b: filled[i - 1] for i, b in enumerate(filled)}  # of the first bucket: the last

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            buckets, ahead, ahead_to = [], [], []
            for i, (value, h) in enumerate(values):
                key = _order(value, h)
                b = bisect_right(bounds, key)
                buckets.append(b)
                if key == firsts[b]:
                    ahead.append(i)
                    ahead_to.append(before[b])
            for rows, to, flag in ((batch, buckets, False), (batch.take(pa.array(ahead, pa.int64())), ahead_to, True)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to, pa.int32()), pa.array([flag] * len(to), pa.bool_()), *rows.columns], names=["bucket", "ahead", "id", "h", "text"]
                )

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, object, str]]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                yield from zip(*(part.column(i).to_pylist() for i in (0, 1, 2, 4)))

    def fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = [Powers(b) for b in BASES]
        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_prefix_edited", "common_prefix_next"]
        types = [schema_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
        out: list[tuple] = []
        held = None
        for bucket, ahead, value, content in pairs(batches):
            if ahead and (held is None or held[0] != bucket):
                continue  # a twin of the row ahead
            prefix = PrefixHash.of(content, powers)
            spans = prefix.spans()
            now = (bucket, value, content, prefix, spans, *prefix.fingerprint(spans))
            if held is not None and held[0] == bucket:
                out.append(_edited(held, now))
            held = None if ahead else now
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    dealt = map_batches(source, deal, f"bucket int, ahead boolean, id {kind}, h long, text string")
    ordered = dealt.repartition("bucket").sortWithinPartitions("bucket", "ahead", F.col("id").asc_nulls_first(), "h")
    made = map_batches(
        ordered, fingerprinted,
        f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
        "common_prefix_edited long, common_prefix_next long",
    )
    return made.withColumnRenamed("id", id_column)


def _edited(held: tuple, following: tuple) -> tuple:
    _, value, content, prefix, spans, fingerprint, sketch = held
    _, _, next_content, next_prefix, _, _, next_sketch = following
    keep = prefix.n - prefix.n // 4
    take = min(prefix.n // 4, next_prefix.n)
    edited = prefix.joined(keep, next_prefix, take)
    # spans that lie in the kept part are known
    known = max(0, keep - SPAN + 1) if min(prefix.n, edited.n) >= SPAN else 0
    edited_spans = np.concatenate((spans[:known], edited.spans(known)))
    edited_fingerprint, edited_sketch = edited.fingerprint(edited_spans)
    digest = sha256((content[:keep] + next_content[:take]).encode("utf-8")).hexdigest()
    return (
        value, prefix.n, digest, fingerprint, edited_fingerprint, likeness(sketch, edited_sketch), likeness(sketch, next_sketch),
        prefix.extension(0, edited, 0), prefix.extension(0, next_prefix, 0),
    )
