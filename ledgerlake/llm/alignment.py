"""Alignment of two tokenizers: which ids of one cover the bytes of which ids of the other, counted over a whole corpus.

A is a byte-level BPE, B a SentencePiece BPE with byte fallback. Their token ends over the bytes of a text give its groups (stretches
between common ends) and its links (every stretch between neighbouring ends lies in one token of each side). A link whose two tokens have
the same bytes, as in every exact one-to-one group, is found by a precomputed array from A ids to B ids and counted in a vector as long
as A's vocabulary; only the links of irregular groups become rows that are shuffled, one per block of texts and pair.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import chunks, has_columns, map_batches, materialize

#: How the byte-level vocabulary cuts a text into words (fixed value).
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

SPACE = "▁"
#: Characters of the texts aligned together, about.
BLOCK_CHARS = 1_000_000
RESULT = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies show each byte as one letter: printable ones as themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


@dataclass
class VocabularyPair:
    """Both vocabularies and the bytes of their tokens, from the contents of the files."""

    a_file: bytes
    b_file: bytes
    a_bytes: list[bytes] = field(init=False)
    b_bytes: list[bytes] = field(init=False)

    def __post_init__(self) -> None:
        import sentencepiece
        import tiktoken

        described = json.loads(self.a_file)
        letters, vocabulary = _byte_letters(), described["model"]["vocab"]
        special = {t["content"] for t in described.get("added_tokens", [])}
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if token not in special:
                self.a_bytes[i] = bytes(letters[c] for c in token)
        made = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in described["model"]["merges"]]
        if any(x >= y for x, y in zip(made, made[1:])):
            raise ValueError("the merges are not in the order of their ids")
        ranks = {token: i for i, token in enumerate(self.a_bytes) if token}
        self.a = tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=self.b_file)
        self.width = self.b.get_piece_size()
        self.b_bytes = [self._piece_bytes(i) for i in range(self.width)]
        self.a_length = np.array([len(t) for t in self.a_bytes], dtype=np.int64)
        self.b_length = np.array([len(t) for t in self.b_bytes], dtype=np.int64)
        of_bytes: dict[bytes, int] = {}
        for i, token in enumerate(self.b_bytes):  # a piece wins over a byte
            if token and (token not in of_bytes or self.b.is_byte(of_bytes[token])):
                of_bytes[token] = i
        #: The B id of the same bytes, or -1.
        self.same = np.array([of_bytes.get(t, -1) for t in self.a_bytes], dtype=np.int64)
        ids = [str(i).encode() for i in range(max(len(self.a_bytes), self.width))]
        #: Texts of a token in a digest: A inside and at the end of a group, then B likewise.
        a, b = ids[: len(self.a_bytes)], ids[: self.width]
        self.shown = [i + b"," for i in a] + [i + b"|" for i in a] + [i + b"," for i in b] + [i + b";" for i in b]

    def _piece_bytes(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:-1], 16)])
        return b"" if self.b.is_control(i) else self.b.id_to_piece(i).replace(SPACE, " ").encode("utf-8")


@lru_cache(maxsize=1)
def _vocabularies(a_file: bytes, b_file: bytes) -> VocabularyPair:
    """Kept by a worker process for its next tasks."""
    return VocabularyPair(a_file, b_file)


@dataclass
class Block:
    """The alignment of some texts; arrays over the texts unless said otherwise."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    digests: list[str]
    codes: np.ndarray  # distinct pairs of the block, sorted: A id * width + B id
    documents: np.ndarray  # texts that hold each pair
    ends: np.ndarray  # of a text's entries in the next two
    pair: np.ndarray  # places in ``codes``, sorted within a text
    times: np.ndarray  # links of that pair in the text


def align(v: VocabularyPair, texts: list[str]) -> Block:
    """Aligns the texts together, on flat arrays. Empty texts and those that a side does not give back byte by byte have no tokens."""
    whole = [(" " + t).encode("utf-8") for t in texts]
    a_ids = [v.a.encode_ordinary(" " + t) if t else [] for t in texts]
    b_ids = v.b.encode(texts, num_threads=1) if texts else []
    a_bytes, b_bytes = v.a_bytes.__getitem__, v.b_bytes.__getitem__
    for k, raw in enumerate(whole):
        if not a_ids[k] or b"".join(map(a_bytes, a_ids[k])) != raw or b"".join(map(b_bytes, b_ids[k])) != raw:
            a_ids[k], b_ids[k] = [], []
    n_a, n_b = (np.array([len(x) for x in ids], dtype=np.int64) for ids in (a_ids, b_ids))
    a = np.array([i for x in a_ids for i in x], dtype=np.int64)
    b = np.array([i for x in b_ids for i in x], dtype=np.int64)
    ends_a, ends_b = np.cumsum(v.a_length[a]), np.cumsum(v.b_length[b])  # both sides of a text have equally many bytes
    place = np.searchsorted(ends_b, ends_a)
    common = ends_b[np.minimum(place, max(len(ends_b) - 1, 0))] == ends_a if len(a) else np.zeros(0, dtype=bool)
    last_b = np.zeros(len(b), dtype=bool)
    last_b[place[common]] = True
    ends = np.sort(np.concatenate((ends_a, ends_b[~last_b])), kind="stable")  # two sorted runs
    links = a[np.searchsorted(ends_a, ends)] * v.width + b[np.searchsorted(ends_b, ends)]

    def per_text(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sums of ``first`` over consecutive runs of the given sizes."""
        total = np.concatenate(([0], np.cumsum(first)))
        stop = np.cumsum(sizes)
        return total[stop] - total[stop - sizes]

    n_groups = per_text(common, n_a)
    n_links = n_a + n_b - n_groups
    owner = np.repeat(np.arange(len(texts)), n_links)
    span = len(v.a_bytes) * v.width
    held, times = np.unique(owner * span + links, return_counts=True)
    codes, pair, documents = np.unique(held % span, return_inverse=True, return_counts=True)
    ends_held = np.cumsum(np.bincount(held // span, minlength=len(texts)))

    group_a = np.cumsum(common) - common  # the group of each A token, counted over all texts
    group_b = np.cumsum(last_b) - last_b
    groups = int(common.sum())
    before_b = np.concatenate(([0], np.cumsum(np.bincount(group_b, minlength=groups))))
    before_a = np.concatenate(([0], np.cumsum(np.bincount(group_a, minlength=groups))))
    tokens = np.empty(len(a) + len(b), dtype=np.int64)  # of each group first A, then B
    size = len(v.a_bytes)
    tokens[np.arange(len(a)) + before_b[group_a]] = a + size * common
    tokens[np.arange(len(b)) + before_a[group_b + 1]] = b + 2 * size + v.width * last_b
    digests, start, shown = [], 0, v.shown.__getitem__
    for n in (n_a + n_b).tolist():
        digests.append(sha256(b"".join(map(shown, tokens[start : start + n].tolist()))[:-1]).hexdigest() if n else "")
        start += n
    return Block(n_a, n_b, n_groups, n_links, digests, codes, documents, ends_held, pair, times)


_BLOCKS = (
    "block string, ids binary, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digests array<string>, "
    "same array<int>, same_documents array<int>, odd array<long>, odd_documents array<int>, ends array<long>, pair binary, times binary"
)


def align_tokenizers(df: DataFrame, a_path: str, b_path: str, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Per row: id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    A pair's count is the number of rows that hold it linked. Texts are encoded once, in blocks of about a million characters; the blocks are
    written under the shared folder with the distinct pairs of each row. Counts of same-bytes pairs and the highest count of each A id
    (both vectors of at most A's vocabulary) go through the driver; counts of the other pairs stay in tables and come back to a block by a
    join on the pair, one row per block and pair.

    Null and empty texts and texts that a vocabulary changes (U+2581 becomes a blank, for one) have no tokens: zeros and an empty digest.
    Special tokens' strings are plain text. Ids may be null or repeated, each row counts; an empty table gives no row. Other columns,
    whatever their names, are left out.
    """
    has_columns(df, id_column, text)
    spark = df.sparkSession
    with open(a_path, "rb") as a_file, open(b_path, "rb") as b_file:
        files = spark.sparkContext.broadcast((a_file.read(), b_file.read()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabularies(*files.value)
        for number, (batch, texts) in enumerate(chunks(batches, "text", BLOCK_CHARS)):
            made = align(v, texts)
            a, b = made.codes // v.width, made.codes % v.width
            same = v.same[a] == b
            order = np.concatenate((np.flatnonzero(same), np.flatnonzero(~same)))  # same-bytes pairs lead the block's list
            place = np.empty(len(order), dtype=np.int32)
            place[order] = np.arange(len(order))
            columns = [
                f"{TaskContext.get().partitionId()}-{number}", _written(batch.column(0)), made.n_a, made.n_b, made.n_groups, made.n_links,
                made.digests, a[same], made.documents[same], made.codes[~same], made.documents[~same], made.ends,
                place[made.pair].tobytes(), made.times.astype(np.int32).tobytes(),
            ]
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, _ARROW.types)], schema=_ARROW)

    source = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text"))
    blocks = materialize(map_batches(source, encode, _BLOCKS), "alignment-blocks")

    size = _vocabularies(*files.value).a_length.size
    counted = blocks.select(F.explode(F.arrays_zip("same", "same_documents")).alias("p")).groupBy("p.same").agg(F.sum("p.same_documents").alias("n"))
    counts = _vector(counted.collect(), size)
    odd = blocks.select("block", F.posexplode(F.arrays_zip("odd", "odd_documents")).alias("at", "p"))
    odd = odd.select("block", "at", F.col("p.odd").alias("code"), F.col("p.odd_documents").alias("n"))
    pairs = materialize(odd.groupBy("code").agg(F.sum("n").alias("n")), "alignment-pairs")
    width = len(_vocabularies(*files.value).b_bytes)
    best = np.maximum(counts, _vector(pairs.groupBy(F.expr(f"code div {width}L").alias("a")).agg(F.max("n")).collect(), size))
    vectors = spark.sparkContext.broadcast((counts, best))

    back = odd.select("block", "at", "code").join(pairs, "code").groupBy("block").agg(F.collect_list(F.struct("at", "n")).alias("found"))
    joined = blocks.drop("odd_documents", "same_documents").join(back, "block", "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = vectors.value
        for batch in batches:
            for row in batch.to_pylist():
                same, odd = np.array(row["same"], dtype=np.int64), np.array(row["odd"], dtype=np.int64)
                found = row["found"] or []
                n = np.concatenate((counts[same], np.zeros(len(odd), dtype=np.int64)))
                n[[len(same) + f["at"] for f in found]] = [f["n"] for f in found]
                highest = n == best[np.concatenate((same, odd // width))]
                pair, times = np.frombuffer(row["pair"], dtype=np.int32), np.frombuffer(row["times"], dtype=np.int32).astype(np.int64)
                ends = np.array(row["ends"], dtype=np.int64)
                sums = [np.diff(np.concatenate(([0], np.cumsum(values)))[np.concatenate(([0], ends))]) for values in (times * highest[pair], times * n[pair])]
                numbers = [row[c] for c in ("n_a", "n_b", "n_groups", "n_links")]
                arrays = [_read(row["ids"]), *[pa.array(c, pa.int64()) for c in [*numbers, *sums]], pa.array(row["digests"], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    kind = df.schema[id_column].dataType.simpleString()
    wanted = joined.select("ids", "n_a", "n_b", "n_groups", "n_links", "digests", "same", "odd", "ends", "pair", "times", "found")
    return map_batches(wanted, finish, f"id {kind}, {RESULT}").withColumnRenamed("id", id_column)


_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())
_ARROW = pa.schema([
    ("block", pa.string()), ("ids", pa.binary()), ("n_a", _LONGS), ("n_b", _LONGS), ("n_groups", _LONGS), ("n_links", _LONGS),
    ("digests", pa.list_(pa.string())), ("same", _INTS), ("same_documents", _INTS), ("odd", _LONGS), ("odd_documents", _INTS),
    ("ends", _LONGS), ("pair", pa.binary()), ("times", pa.binary()),
])


def _written(ids: pa.Array) -> bytes:
    """Ids of any type, with their nulls, as one value."""
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([ids], names=["id"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _read(written: bytes) -> pa.Array:
    return pa.ipc.open_stream(written).read_all().column(0).combine_chunks()


def _vector(rows: list, size: int) -> np.ndarray:
    """(id, number) rows as a vector over all ids."""
    out = np.zeros(size, dtype=np.int64)
    for i, n in rows:
        out[i] = n
    return out
