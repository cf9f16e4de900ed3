"""Benchmark passages in documents, exact or reworded, by latent semantic retrieval.

The TF-IDF matrix of the benchmark's passages is reduced by a distributed randomised SVD; its weights count all documents. A block
with many passages gets several latent spaces, so that the rank follows their number. Every passage of every document is projected
and compared with all passages of the benchmark by cosine. Beside that, every run of ``GRAM`` words that an item has too makes a
candidate, so that no exact passage depends on the cosine. Candidates are checked word by word: the longest common subsequence with
the item, and whether the item's answer stands there too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import chunks, has_columns, map_batches, materialize, ship_package, slices, sum_arrays

#: Words in half a passage; passages are two neighbouring halves, so every span of 17 words lies within one.
HALF = 16
RANK = 128
OVERSAMPLE = 8
#: Passages of one latent space on average, at most: as many as ``RANK`` was measured with.
SPACE_PASSAGES = 400
#: Words of the runs that make a candidate without the cosine; a shorter item is a run itself.
GRAM = 3
#: Least cosine of a candidate.
NEAR = 0.6
#: Least share of the item's words in common order: of items with an answer of their own and of short ones, and together with the answer.
SAME, REWORDED, ANSWER = 0.8, 0.6, 0.8
#: From so many words on, an item without an answer of its own is found by the share ``REWORDED`` alone; clean texts come near it below.
LONG_ITEM = 12
#: Items and bytes of benchmark text that are broadcast and searched in one pass; a larger benchmark takes several passes.
BLOCK_ITEMS = 2000
BLOCK_BYTES = 1 << 20
#: Words projected together.
SEGMENT = HALF * 8192

#: Words whose stretches are looked at together for whether any item's words are there.
STRETCH = 256

_last_sentence = re.compile(r"[^.!?]*\w[^.!?]*[.!?\s]*$")


def words_of(text: str) -> list[str]:
    """Runs of letters, digits and underscores, in lower case."""
    text = text.lower()
    for c in set(text):
        if not (c.isalnum() or c == "_"):
            text = text.replace(c, " ")
    return text.split()


def answer_of(text: str) -> str:
    """The last sentence of an item: its answer where the benchmark has none of its own."""
    found = _last_sentence.search(text)
    return found.group() if found else ""


@dataclass
class Item:
    item_id: object
    words: list[str]
    answer: list[str]
    told: bool = False  # whether the answer is the benchmark's own


def passages(words: list[str]) -> Iterator[list[str]]:
    for start in range(0, max(1, len(words) - HALF), HALF):
        yield words[start : start + 2 * HALF]


def common_subsequence(masks: dict[str, int], words: list[str]) -> int:
    """Length of the longest common subsequence; ``masks`` has the positions of each word of one side as bits."""
    row = -1
    for word in words:
        hit = row & masks.get(word, 0)
        row = (row + hit) | (row - hit)
    return (~row).bit_count()


def word_masks(words: list[str]) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, word in enumerate(words):
        masks[word] = masks.get(word, 0) | 1 << i
    return masks


class Checker:
    """The word-by-word check of one item."""

    def __init__(self, item: Item):
        self.item = item
        self.masks, self.answer = word_masks(item.words), word_masks(item.answer)
        self.distinct = frozenset(item.words)
        self.n, self.n_answer = len(item.words), len(item.answer)
        self.least = len(self.distinct) - (1 - REWORDED) * self.n - 1e-9  # distinct words that a span must have
        self.alone = REWORDED if self.n >= LONG_ITEM and not item.told else SAME

    def accepts(self, share: float, answered: bool) -> bool:
        return share >= self.alone or share >= REWORDED and answered

    def check(self, words: list[str], start: int, end: int) -> tuple[float, bool]:
        """Best share in common order of a span a little longer than the item around ``[start, end)``, and whether the answer is there."""
        low, high = max(0, start - self.n), min(len(words), end + self.n)
        if len(self.distinct.intersection(words[low:high])) < self.least:
            return 0.0, False
        width, best, at = self.n + self.n // 4 + 1, 0, low
        for i in range(low, max(low + 1, high - width + max(1, self.n // 8)), max(1, self.n // 8)):
            found = common_subsequence(self.masks, words[i : i + width])
            if found > best:
                best, at = found, i
        near = words[max(0, at - self.n_answer) : at + width + self.n_answer]
        answered = bool(self.n_answer) and common_subsequence(self.answer, near) >= ANSWER * self.n_answer
        return best / self.n, answered


@dataclass
class Part:
    """One latent space of a block: the vectors of its words, and its passages as unit vectors."""

    row: np.ndarray  # of each word of the block: its row in ``vectors``; the last row is zero and stands for words of other parts
    vectors: np.ndarray  # row x rank, weighted
    passages: np.ndarray  # passage x rank
    owner: np.ndarray  # item of each passage


@dataclass
class Grams:
    """All runs of ``GRAM`` words of a block's items, sorted by key."""

    keys: np.ndarray  # distinct
    first: np.ndarray  # where each key's places begin, and their end
    item: np.ndarray
    place: np.ndarray  # of the run within the item

    @classmethod
    def of(cls, items: list[Item], vocabulary: dict[str, int]) -> Grams:
        keys, owner, place = [], [], []
        for n, item in enumerate(items):
            found = gram_keys(np.array([vocabulary[w] for w in item.words], dtype=np.int64), min(GRAM, len(item.words)), len(vocabulary))
            keys.append(found)
            owner.append(np.full(len(found), n))
            place.append(np.arange(len(found)))
        keys, owner, place = (np.concatenate(a) for a in (keys, owner, place))
        order = np.argsort(keys, kind="stable")
        distinct, first = np.unique(keys[order], return_index=True)
        return cls(distinct, np.append(first, len(keys)), owner[order], place[order])

    def hits(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every run that an item has: where it stands in ``keys``, the item, the run's place in the item."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        here = np.flatnonzero(self.keys[at] == keys)
        begin, end = self.first[at[here]], self.first[at[here] + 1]
        many = end - begin
        flat = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin, many)
        return np.repeat(here, many), self.item[flat], self.place[flat]


def gram_keys(ids: np.ndarray, width: int, size: int) -> np.ndarray:
    """One number for each run of ``width`` word ids, different for every run and width; -1 where a word is unknown (id -1)."""
    count = max(0, len(ids) - width + 1)
    keys, known = np.zeros(count, dtype=np.int64), np.ones(count, dtype=bool)
    for i in range(width):
        part = ids[i : i + count]
        keys = keys * (size + 1) + part + 1
        known &= part >= 0
    return np.where(known, keys, -1)


@dataclass
class LatentSpace:
    """One block of the benchmark: its words, its latent spaces, and its runs of words."""

    items: list[Item]
    vocabulary: dict[str, int]
    parts: list[Part]
    grams: Grams


def _blocks(benchmark: DataFrame, text: str, item: str, answer: str | None) -> tuple[DataFrame, int]:
    told = F.col(f"`{answer}`") if answer else F.lit(None).cast("string")
    items = benchmark.select(F.col(f"`{item}`").alias("item_id"), F.col(f"`{text}`").alias("text"), told.alias("answer")).where("text IS NOT NULL").distinct()
    size = items.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    count = max(1, -(-size["n"] // BLOCK_ITEMS), -(-(size["bytes"] or 0) // BLOCK_BYTES))
    # half as many again, as hashing fills blocks unevenly
    count = count if count == 1 else count * 3 // 2
    return items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(count))), count


def _weights(docs: DataFrame, vocabulary: dict[str, int]) -> np.ndarray:
    """Inverse document frequency over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        known = shared.value
        keys, counts = frozenset(known), np.zeros(len(known) + 1)
        for _, texts in chunks(batches, "text"):
            found: list[int] = []
            for text in texts:
                found.extend(map(known.__getitem__, keys.intersection(words_of(text))))
            counts += np.bincount(np.array(found, dtype=np.int64), minlength=len(known) + 1)
            counts[-1] += len(texts)
        return counts

    counts = sum_arrays(docs, run)
    shared.destroy()
    if counts is None:
        counts = np.zeros(len(vocabulary) + 1)
    return np.log((counts[-1] + 1) / (counts[:-1] + 1)) + 1e-3


def latent_space(items: DataFrame, docs: DataFrame) -> LatentSpace | None:
    """Of one block of items (``item_id, text, answer``); None if it has no word.

    Passages are dealt by a hash of their words to spaces of about ``SPACE_PASSAGES``. The sketch of each is ``A'(A X)`` for a random
    ``X``, refined by one power iteration; Spark sums it over the passages, and only arrays of words times rank reach the driver.
    """
    rows = []
    for r in items.select("item_id", "text", "answer").collect():
        own = words_of(r["answer"] or "")
        rows.append(Item(r["item_id"], words_of(r["text"]), own or words_of(answer_of(r["text"])), bool(own)))
    rows = sorted((i for i in rows if i.words), key=lambda i: (str(i.item_id), i.words))
    if not rows:
        return None
    vocabulary = {w: n for n, w in enumerate(sorted({w for i in rows for w in i.words}))}
    weights = _weights(docs, vocabulary)
    count = -(-sum(1 for i in rows for _ in passages(i.words)) // SPACE_PASSAGES)
    held: list[list[tuple[int, list[str]]]] = [[] for _ in range(count)]
    for n, item in enumerate(rows):
        for words in passages(item.words):
            held[_part_of(words, count)].append((n, words))
    parts = [_part(items, some, number, count, vocabulary, weights) for number, some in enumerate(held) if some]
    return LatentSpace(rows, vocabulary, parts, Grams.of(rows, vocabulary))


def _part_of(words: list[str], count: int) -> int:
    return crc32(" ".join(words).encode("utf-8", "surrogatepass")) % count


def _part(items: DataFrame, held: list[tuple[int, list[str]]], number: int, count: int, vocabulary: dict[str, int], weights: np.ndarray) -> Part:
    """The latent space of the passages ``held`` (item and words), which are those of ``items`` that are dealt to ``number``."""
    context = items.sparkSession.sparkContext
    own = {w: n for n, w in enumerate(sorted({w for _, words in held for w in words}))}
    worth = weights[[vocabulary[w] for w in own]]
    shared = context.broadcast((own, worth))

    def matrix(words: list[str], known, weights) -> tuple[np.ndarray, np.ndarray]:
        at = np.array([known[w] for w in words], dtype=np.int64)
        values = weights[at]
        _, back = np.unique(at, return_inverse=True)
        return at, values / np.sqrt((np.bincount(back, values) ** 2).sum())

    def multiply(basis: np.ndarray, function) -> np.ndarray:
        given = context.broadcast(basis)

        def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            known, weights = shared.value
            total = None
            for _, texts in chunks(batches, "text"):
                for text in texts:
                    for words in passages(words_of(text)):
                        if words and _part_of(words, count) == number:
                            at, values = matrix(words, known, weights)
                            total = function(total, at, values, values @ given.value[at])
            return None if total is None else total.ravel()

        made = sum_arrays(items.select("text").coalesce(1), run)  # a block has a bounded size: one array instead of one a task
        given.destroy()
        return made

    def back(total, at, values, row):
        total = np.zeros((size, width)) if total is None else total
        np.add.at(total, at, values[:, None] * row)
        return total

    def gram(total, at, values, row):
        return np.outer(row, row) + (0 if total is None else total)

    size = len(own)
    width = min(size, RANK + OVERSAMPLE)
    basis = np.random.default_rng(11).normal(size=(size, width))
    for _ in range(2):
        basis, _ = np.linalg.qr(multiply(basis, back).reshape(size, width))
    values, turn = np.linalg.eigh(multiply(basis, gram).reshape(width, width))
    order = np.argsort(values)[::-1][:RANK]
    shared.destroy()
    order = order[values[order] > 1e-9 * max(values.max(), 1e-12)]
    vectors = (worth[:, None] * (basis @ turn[:, order])).astype(np.float32)
    points = np.array([vectors[[own[w] for w in words]].sum(axis=0) for _, words in held])
    points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)
    row = np.full(len(vocabulary), size, dtype=np.int32)
    row[[vocabulary[w] for w in own]] = np.arange(size)
    return Part(row, np.concatenate((vectors, np.zeros_like(vectors[:1]))), points.astype(np.float32), np.array([n for n, _ in held]))


class Finder:
    """Searches whole texts for the items of a block."""

    def __init__(self, space: LatentSpace):
        self.space = space
        self.checkers = [Checker(i) for i in space.items]
        self.widths = sorted({min(GRAM, c.n) for c in self.checkers})
        self.least = np.array([c.least for c in self.checkers])
        self.reach = 2 * HALF + 2 * max(c.n for c in self.checkers)  # what a check looks at, at most
        holds = [(space.vocabulary[w], n) for n, c in enumerate(self.checkers) for w in c.distinct]
        word, item = np.array(sorted(holds), dtype=np.int64).T
        self.item_of = item
        self.first = np.searchsorted(word, np.arange(len(space.vocabulary) + 1))

    def _ids(self, words: list[str]) -> np.ndarray:
        """Ids of the words, -1 for words of no item and for stretches that hold too few words of every item to pass its check."""
        ids = np.fromiter(map(self.space.vocabulary.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        kept = np.full(len(ids), -1, dtype=np.int64)
        for start in range(0, len(ids), STRETCH):
            some = ids[start : start + STRETCH + self.reach]
            found = np.unique(some[some >= 0])
            size = self.first[found + 1] - self.first[found]
            flat = np.arange(size.sum()) + np.repeat(self.first[found] - (np.cumsum(size) - size), size)
            if (np.bincount(self.item_of[flat], minlength=len(self.least)) >= self.least).any():
                kept[start : start + STRETCH + self.reach] = some
        return kept

    def _halves(self, ids: np.ndarray, part: Part) -> np.ndarray:
        """Sum of the vectors of each run of ``HALF`` words; words that are not of the part add nothing."""
        size = len(part.vectors) - 1
        out = np.zeros((-(-len(ids) // HALF), part.vectors.shape[1]), dtype=np.float32)
        for start in range(0, len(ids), SEGMENT):
            some = ids[start : start + SEGMENT]
            rows = np.where(some >= 0, part.row[some], size)
            at = np.flatnonzero(rows < size)
            if not len(at):
                continue
            half = (at + start) // HALF
            first = np.flatnonzero(np.concatenate(([True], half[1:] != half[:-1])))
            out[half[first]] = np.add.reduceat(part.vectors[rows[at]], first, axis=0)
        return out

    def find(self, texts: list[str]) -> list[dict[int, tuple[float, float, bool]]]:
        """For each text, of every item found: share in common order, cosine (0 if found by a run of words), whether the answer is there."""
        lists = [words_of(t) for t in texts]
        ids = [self._ids(w) for w in lists]
        out: list[dict[int, tuple[float, float, bool]]] = [{} for _ in texts]
        for part in self.space.parts:
            self._by_cosine(part, lists, ids, out)
        for t, some in enumerate(ids):
            self._by_runs(t, lists[t], some, out)
        return out

    def _check(self, out: list[dict[int, tuple[float, float, bool]]], t: int, item: int, words: list[str], start: int, end: int, cosine: float) -> None:
        known = out[t].get(item)
        if known and known[0] == 1.0:
            return
        share, answered = self.checkers[item].check(words, start, min(len(words), end))
        if self.checkers[item].accepts(share, answered) and (not known or share > known[0]):
            out[t][item] = (share, cosine, answered)

    def _by_cosine(self, part: Part, lists: list[list[str]], ids: list[np.ndarray], out: list[dict[int, tuple[float, float, bool]]]) -> None:
        halves = [self._halves(w, part) for w in ids]
        windows = np.concatenate([h[:-1] + h[1:] if len(h) > 1 else h for h in halves])
        counts = np.array([max(1, len(h) - 1) if len(h) else 0 for h in halves])
        text_of = np.repeat(np.arange(len(lists)), counts)
        first = np.concatenate(([0], np.cumsum(counts)[:-1]))
        size = np.linalg.norm(windows, axis=1)
        filled = np.flatnonzero(size > 0)
        for i in range(0, len(filled), 4096):
            at = filled[i : i + 4096]
            cosine = (windows[at] / np.maximum(size[at, None], 1e-9)) @ part.passages.T
            done = set()
            for row, passage in zip(*(a.tolist() for a in np.nonzero(cosine >= NEAR))):
                item = int(part.owner[passage])
                if (row, item) in done:
                    continue
                done.add((row, item))
                t = int(text_of[at[row]])
                start = (int(at[row]) - int(first[t])) * HALF
                self._check(out, t, item, lists[t], start, start + 2 * HALF, float(cosine[row, passage]))

    def _by_runs(self, t: int, words: list[str], ids: np.ndarray, out: list[dict[int, tuple[float, float, bool]]]) -> None:
        """Where the text has a run of ``GRAM`` words of an item, or a whole shorter item; each place of an item once."""
        done = set()
        for width in self.widths:
            for at, item, place in zip(*(a.tolist() for a in self.space.grams.hits(gram_keys(ids, width, len(self.space.vocabulary))))):
                n = self.checkers[item].n
                start = max(0, at - place)
                if (item, start // n) not in done:
                    done.add((item, start // n))
                    self._check(out, t, item, words, start, start + n, 0.0)


def _spaces(docs: DataFrame, benchmark: DataFrame, text: str, item_text: str, item: str, answer: str | None) -> Iterator[LatentSpace]:
    items, count = _blocks(benchmark, item_text, item, answer)
    texts = docs.select(F.col(f"`{text}`").alias("text"))
    if count > 1:
        items = materialize(items, "benchmark-blocks")
    for number in range(count):
        space = latent_space(items.where(F.col("block") == number), texts)
        if space:
            yield space


def contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", id_column: str = "doc_id", item_text: str = "text", item: str = "item_id", answer: str | None = None
) -> DataFrame:
    """One row for every document and item found in it: id, item id, ``share`` of the item's words in common order, ``cosine``, ``answered``.

    All passages of all documents are searched for all items, in blocks of the benchmark. Nothing of the documents is shuffled. Null and
    empty texts and items without a word match nothing; repeated documents are reported for each, repeated rows of the benchmark once,
    equal texts under several item ids by each id. An empty table on either side gives an empty result.
    """
    has_columns(docs, id_column, text)
    has_columns(benchmark, item, item_text)
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = docs.schema[id_column].dataType, benchmark.schema[item].dataType
    schema = f"id {kinds[0].simpleString()}, item {kinds[1].simpleString()}, share double, cosine double, answered boolean"
    arrow = [to_arrow_type(k) for k in kinds] + [pa.float64(), pa.float64(), pa.bool_()]
    source = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text"))
    found = docs.sparkSession.createDataFrame([], schema)
    for space in _spaces(docs, benchmark, text, item_text, item, answer):
        shared = docs.sparkSession.sparkContext.broadcast(_plain(space))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = Finder(_space(shared.value))
            for batch, texts in chunks(batches, "text"):
                ids, rows = batch.column(0).to_pylist(), []
                for value, hits in zip(ids, finder.find(texts)):
                    rows.extend((value, finder.space.items[n].item_id, *hit) for n, hit in hits.items())
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow)], names=["id", "item", "share", "cosine", "answered"])

        found = found.unionByName(map_batches(source, run, schema))
    return found.withColumnsRenamed({"id": id_column, "item": item})


def _plain(space: LatentSpace) -> tuple:
    return [(i.item_id, i.words, i.answer, i.told) for i in space.items], space.vocabulary, [p.__dict__ for p in space.parts], space.grams.__dict__


def _space(plain: tuple) -> LatentSpace:
    return LatentSpace([Item(*i) for i in plain[0]], plain[1], [Part(**p) for p in plain[2]], Grams(**plain[3]))


def _holds(docs: DataFrame, space: LatentSpace, text: str) -> Column:
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(_plain(space))

    @F.pandas_udf("boolean")
    def holds(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder(_space(shared.value))
        for series in parts:
            texts = [t or "" for t in series]
            out: list[bool] = []
            for start, end in slices(texts):
                out.extend(map(bool, finder.find(texts[start:end])))
            yield pd.Series(out, dtype=bool)

    return holds(F.col(f"`{text}`"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item: str = "item_id", answer: str | None = None) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with their columns; a benchmark without items keeps all."""
    kept = docs
    for space in _spaces(docs, benchmark, text, item_text, item, answer):
        kept = kept.where(~_holds(docs, space, text))
    return kept
