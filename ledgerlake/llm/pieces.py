"""SentencePiece BPE with byte fallback: encoding in vectorised merge rounds, and decoding.

The vocabulary is read from a given model file; nothing is trained. A text is cut where no piece of the vocabulary can reach
across (before a space mark, and around characters that no longer piece contains), so the parts can be encoded once and kept.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ledgerlake.llm.common import chunks, has_columns, map_batches

SPACE = "▁"
NONE = np.int64(2**31 - 1)

#: Parts kept per task; beyond it the store starts anew (about 300 bytes each).
MOST_KEPT = 300_000
#: Longer parts (runs of blanks, base64) are merged by a heap, as a round each per merge would cost the square of their length.
LONG_PART = 128
#: Parts merged together: their arrays stay in the processor's cache.
MERGED_TOGETHER = 8000


@dataclass
class PieceTables:
    """What the tasks need of a model: it is built once by the driver and broadcast (about 3 MB for 32,000 pieces)."""

    pieces: dict[str, int]
    names: list[str]
    byte_ids: list[int]
    end_id: int
    pairs: np.ndarray  # sorted left * width + right
    ranks: np.ndarray  # of the merged piece: 0 is merged first; equal scores share a rank
    merged: np.ndarray
    width: int
    cut: str  # the pattern of the parts of a text
    controls: frozenset[int]
    unknown: dict[int, str]  # what is shown for ids that stand for no piece

    @classmethod
    def load(cls, path: str) -> PieceTables:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i)}
        bytes_ = [i for i in range(size) if model.is_byte(i)]
        if len(bytes_) != 256:
            raise ValueError("the model has no byte fallback")
        normal = [i for i in range(size) if i not in special and i not in set(bytes_) and not model.is_unused(i)]
        pieces = {names[i]: i for i in normal}
        symbols = dict(pieces)
        inner = {c for p in pieces if len(p) > 1 for c in p}
        for c in sorted(inner):
            symbols.setdefault(c, len(names) + len(symbols) - len(pieces))
        if any(a != SPACE and b == SPACE for p in pieces for a, b in zip(p, p[1:])):
            raise ValueError("a piece reaches over the start of a word")
        width = size + len(symbols) - len(pieces) + 1
        order = {s: r for r, s in enumerate(sorted({model.get_score(i) for i in normal}, reverse=True))}
        table = []
        for piece, i in pieces.items():
            for cut in range(1, len(piece)):
                left, right = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if left is not None and right is not None:
                    table.append((left * width + right, order[model.get_score(i)], i))
        table.sort()
        columns = np.array(table, dtype=np.int64).reshape(-1, 3)
        return cls(
            symbols, names, sorted(bytes_, key=lambda i: int(names[i][1:-1], 16)), model.eos_id(),
            columns[:, 0].copy(), columns[:, 1].copy(), columns[:, 2].copy(), width, _part_pattern(pieces),
            frozenset(i for i in special if model.is_control(i)), {i: model.decode([i]) for i in special if model.is_unknown(i)},
        )


def _part_pattern(pieces: Iterable[str]) -> str:
    """Parts no piece reaches across: space marks lead a part, letters and other characters part if no piece mixes them,
    and a character that no longer piece contains stands alone."""
    pieces = [p for p in pieces if len(p) > 1]
    inner = {c for p in pieces for c in p} - {SPACE}
    mixed = any(a.isalpha() != b.isalpha() for p in pieces for a, b in zip(p, p[1:]) if SPACE not in (a, b))
    kinds = [inner] if mixed else [{c for c in inner if c.isalpha()}, {c for c in inner if not c.isalpha()}]
    classes = [re.escape("".join(sorted(k))) for k in kinds if k]
    return "|".join([f"{SPACE}*[{c}]+" for c in classes] + [f"{SPACE}+", f"[^{''.join(classes)}{SPACE}]"])


class PieceCoder:
    """Encodes and decodes with the tables; keeps the parts it has seen."""

    def __init__(self, tables: PieceTables, form: Callable[[tuple[int, ...]], object] | None = None):
        """``form``: what is kept of the ids of a part; the ids themselves by default."""
        self.t = tables
        self.form = form or tuple
        self.kept: dict[str, object] = {}
        self.cut = re.compile(tables.cut).findall
        self.is_byte = {i: b for b, i in enumerate(tables.byte_ids)}
        self.shown = [n.replace(SPACE, " ") for n in tables.names]
        for i in tables.controls:
            self.shown[i] = ""
        for i, shown in tables.unknown.items():
            self.shown[i] = shown
        self.of_char = np.full(0x110000, tables.width - 1, dtype=np.int32)
        for c, i in tables.pieces.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i

    def parts(self, text: str) -> list[str]:
        """The text with its dummy blank, cut into parts; none for an empty text."""
        return self.cut(SPACE + text.replace(" ", SPACE)) if text else []

    def learn(self, texts_parts: Iterable[list[str]]) -> None:
        """Encode all parts that are not kept yet, together."""
        new = set()
        for parts in texts_parts:
            new.update(parts)
        if len(self.kept) > MOST_KEPT:
            self.kept = {}
        new = [p for p in new if p not in self.kept]
        short = [p for p in new if len(p) <= LONG_PART]
        for i in range(0, len(short), MERGED_TOGETHER):
            block = short[i : i + MERGED_TOGETHER]
            self.kept.update(zip(block, map(self.form, self.merge_rounds(block))))
        for part in new:
            if len(part) > LONG_PART:
                self.kept[part] = self.form(self.merge_by_heap(part))

    def encode(self, text: str) -> list[int]:
        """Ids without the end id; for coders that keep ids."""
        parts = self.parts(text)
        self.learn([parts])
        return [i for p in parts for i in self.kept[p]]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; ``NONE`` if there is no such piece."""
        key = left * self.t.width + right
        at = np.minimum(np.searchsorted(self.t.pairs, key), len(self.t.pairs) - 1)
        hit = self.t.pairs[at] == key
        return np.where(hit, self.t.ranks[at], NONE), self.t.merged[at]

    def merge_rounds(self, words: list[str]) -> list[tuple[int, ...]]:
        """All words at once: in each round every word merges its leftmost pair of lowest rank; done words leave the arrays."""
        if not words:
            return []
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        symbols = self.of_char[codes].astype(np.int64)
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        owner = np.repeat(np.arange(len(words)), lengths)
        last = np.zeros(len(symbols), dtype=bool)
        last[starts + lengths - 1] = True
        ranks, into = np.full(len(symbols), NONE), np.zeros(len(symbols), dtype=np.int64)
        inner = np.flatnonzero(~last)
        ranks[inner], into[inner] = self._rank(symbols[inner], symbols[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            lowest = np.minimum.reduceat((ranks << 32) | np.arange(len(ranks)), starts)
            open_ = (lowest >> 32) < NONE
            if not open_.all():
                stay = np.repeat(open_, lengths)
                done.append((owner[~stay], symbols[~stay]))
                shift = np.cumsum(~stay)
                at = (lowest & 0xFFFFFFFF)[open_]
                at = at - shift[at]
                symbols, owner, last, ranks, into, lengths = symbols[stay], owner[stay], last[stay], ranks[stay], into[stay], lengths[open_]
                if not len(symbols):
                    break
            else:
                at = lowest & 0xFFFFFFFF
            symbols[at] = into[at]
            last[at] |= last[at + 1]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # one symbol has gone from every word before
            symbols, owner, last, ranks, into = symbols[keep], owner[keep], last[keep], ranks[keep], into[keep]
            lengths = lengths - 1
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            ranks[at[last[at]]] = NONE
            left = at[~last[at]]
            before = at[at > starts] - 1
            changed = np.concatenate((left, before))
            ranks[changed], into[changed] = self._rank(symbols[changed], symbols[changed + 1])
        owner = np.concatenate([o for o, _ in done])
        symbols = np.concatenate([s for _, s in done])
        order = np.argsort(owner, kind="stable")
        ends = np.cumsum(np.bincount(owner, minlength=len(words)))
        flat = symbols[order].tolist()
        size, out, begin = len(self.t.names), [], 0
        for word, end in zip(words, ends.tolist()):
            ids = flat[begin:end]
            out.append(tuple(ids) if not ids or max(ids) < size else self._with_bytes(word, ids))
            begin = end
        return out

    def _with_bytes(self, word: str, ids: list[int]) -> tuple[int, ...]:
        """Symbols that are no pieces (always one character) become the ids of their bytes."""
        out, at = [], 0
        for i in ids:
            if i < len(self.t.names):
                out.append(i)
                at += len(self.t.names[i])
            else:
                out.extend(self.t.byte_ids[b] for b in word[at].encode("utf-8"))
                at += 1
        return tuple(out)

    def merge_by_heap(self, word: str) -> tuple[int, ...]:
        """The same merges, lowest rank and then leftmost first, for a long part."""
        unknown = self.t.width - 1
        symbols = [self.t.pieces.get(c, unknown) for c in word]
        after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        ranks, into = self._rank(np.array(symbols[:-1], dtype=np.int64), np.array(symbols[1:], dtype=np.int64))
        heap = [(int(r), i, symbols[i], symbols[i + 1], int(m)) for i, (r, m) in enumerate(zip(ranks, into)) if r < NONE]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            j = after[i]
            if j < len(word):
                key = symbols[i] * self.t.width + symbols[j]
                at = int(np.searchsorted(self.t.pairs, key))
                if at < len(self.t.pairs) and self.t.pairs[at] == key:
                    heapq.heappush(heap, (int(self.t.ranks[at]), i, symbols[i], symbols[j], int(self.t.merged[at])))

        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != left or j >= len(word) or symbols[j] != right:
                continue
            symbols[i], symbols[j], after[i] = new, -1, after[j]
            if after[i] < len(word):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return self._with_bytes(word, [s for s in symbols if s >= 0])

    def decode_part(self, ids: Sequence[int]) -> str:
        """Pieces and byte runs as text, space marks as blanks; bytes that are no UTF-8 become U+FFFD."""
        if self.is_byte.keys().isdisjoint(ids):
            return "".join(map(self.shown.__getitem__, ids))
        out, run = [], bytearray()
        for i in ids:
            if i in self.is_byte:
                run.append(self.is_byte[i])
                continue
            if run:
                out.append(_utf8(run))
                run = bytearray()
            out.append(self.shown[i])
        if run:
            out.append(_utf8(run))
        return "".join(out)

    def decode(self, ids: Sequence[int]) -> str:
        """The text of whole ids: as :meth:`decode_part`, without the dummy blank if a piece leads; a blank of a byte stays."""
        text = self.decode_part(ids)
        first = next((i for i in ids if i not in self.t.controls), None)
        led = first is not None and first not in self.is_byte and first not in self.t.unknown and self.t.names[first].startswith(SPACE)
        return text[1:] if led else text


def _utf8(run: bytearray) -> str:
    """Strict UTF-8; every byte that is no part of a character becomes U+FFFD of its own."""
    try:
        return run.decode("utf-8")
    except UnicodeDecodeError as error:
        good = run[: error.start].decode("utf-8")
        return good + "�" + _utf8(run[error.start + 1 :])


def piece_digests(df: DataFrame, model_path: str, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Per row: id, ``n_tokens`` (with the end id), ``ids_sha256``, ``decoded_sha256``; ids and decoded text are not kept.

    No shuffle; memory is bounded by the parts kept and one chunk of texts. Null and empty texts are the end id alone and
    decode to the empty text. Rows are never dropped or merged; an id may be null or repeated.
    """
    has_columns(df, id_column, text)
    tables = df.sparkSession.sparkContext.broadcast(PieceTables.load(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = [b"%d" % i for i in range(len(tables.value.names))]
        coder = PieceCoder(tables.value, lambda ids: (b" ".join([written[i] for i in ids]), len(ids), coder.decode_part(ids)))
        end = written[coder.t.end_id]
        for batch, texts in chunks(batches, "text"):
            all_parts = [coder.parts(t) for t in texts]
            coder.learn(all_parts)
            sizes, hashes, decoded = [], [], []
            for parts in all_parts:
                rows = [coder.kept[p] for p in parts]
                sizes.append(sum([r[1] for r in rows]) + 1)
                hashes.append(sha256(b" ".join([r[0] for r in rows] + [end])).hexdigest())
                back = "".join([r[2] for r in rows])
                decoded.append(sha256((back[1:] if back.startswith(" ") else back).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = df.schema[id_column].dataType.simpleString()
    source = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text"))
    made = map_batches(source, run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return made.withColumnRenamed("id", id_column)


def encode_pieces(df: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """All columns of ``df`` with ``ids`` (array of int, end id last) and ``decoded`` (string); such columns are replaced.

    Rows stay as they are; a null or empty text gives the end id alone and an empty decoded text. A task holds the ids of one chunk of
    texts, as flat arrays.
    """
    has_columns(df, text)
    tables = df.sparkSession.sparkContext.broadcast(PieceTables.load(model_path))
    kept = [f for f in df.schema.fields if f.name.lower() not in ("ids", "decoded")]
    names = [f"c{i}" for i in range(len(kept))]
    at = [f.name for f in kept].index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceCoder(tables.value, lambda ids: (ids, coder.decode_part(ids)))
        end = (coder.t.end_id,)
        for batch, texts in chunks(batches, names[at]):
            all_parts = [coder.parts(t) for t in texts]
            coder.learn(all_parts)
            flat, ends, decoded = [], [0], []
            for parts in all_parts:
                rows = [coder.kept[p] for p in parts]
                ids = np.fromiter(chain.from_iterable([*[r[0] for r in rows], end]), dtype=np.int32)
                flat.append(ids)
                ends.append(ends[-1] + len(ids))
                back = "".join([r[1] for r in rows])
                decoded.append(back[1:] if back.startswith(" ") else back)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat)))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, pa.array(decoded, pa.string())], names=[*names, "ids", "decoded"])

    plain = df.select(*[F.col(f"`{f.name}`").alias(n) for f, n in zip(kept, names)])
    schema = StructType([*[StructField(n, f.dataType) for f, n in zip(kept, names)], StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())])
    made = map_batches(plain, run, schema)
    return made.select(*[F.col(n).alias(f.name) for f, n in zip(kept, names)], "ids", "decoded")


def piece_lengths(df: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """One column ``n_tokens``: the encoded length of each row's whole text, the end id included."""
    has_columns(df, text)
    tables = df.sparkSession.sparkContext.broadcast(PieceTables.load(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceCoder(tables.value, len)
        for _, texts in chunks(batches, "text"):
            all_parts = [coder.parts(t) for t in texts]
            coder.learn(all_parts)
            get = coder.kept.__getitem__
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(get, p)) + 1 for p in all_parts], pa.int64())], names=["n_tokens"])

    return map_batches(df.select(F.col(f"`{text}`").alias("text")), run, "n_tokens long")
