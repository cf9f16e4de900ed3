"""Scores of a log-bilinear language model, trained in numpy by noise-contrastive estimation.

The words before a token, as vectors, are mapped by one matrix per position and added; the sum's products with the vectors of all
outputs, plus their biases, are normalised over all outputs. Outputs are the end token, the commonest words and classes of word
shapes. A rarer word is its class times its discounted share in the class. The discounts of a class are shared alike by the words of the
class that were never seen, whose number is estimated from the words seen once and twice; so the probabilities of all known words and
of that many unknown ones add up to one.

Counts are of the whole training corpus and live in a table; only the commonest words, the class totals and the parameters pass
through the driver, all of bounded size. Texts are written once as the numbers of their outputs; training and scoring read those. Training
passes once over all training documents: every task trains on its rows from the same start, and the tasks' parameters are
averaged by their tokens, round after round. The normalisers of all contexts are computed once, in tasks, and broadcast.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import chunks, has_columns, map_batches, materialize, slices, sum_arrays
from ledgerlake.llm.language import held_out

#: The end of a text. No word contains white space.
END = b" "
CONTEXT = 2
DIMENSION = 32
#: Words that are outputs of their own.
OUTPUT_WORDS = 768
ENDINGS = 4
SUFFIXES = 64
CLASSES = ENDINGS * SUFFIXES
#: Words whose counts are broadcast: about 10 MB. All others are counted in and looked up from a table.
HEAD_WORDS = 60_000
DISCOUNT = 0.75
NOISE = 64
BATCH = 2048
ROUNDS = 2
RATE = 0.1
#: Distinct words a task counts before it sends them on.
MOST_WORDS = 200_000
#: Rarer words whose class a task keeps.
MOST_RARE = 100_000
#: Tokens whose windows are built together.
CODED_TOGETHER = 400_000
#: Characters of the texts that are coded together.
CODED_CHARS = 1_000_000


def words_of(text: str) -> list[bytes]:
    """Words with A-Z lower-cased, split at the six ASCII white space characters."""
    return text.encode("utf-8").lower().split()


def shape_class(word: bytes) -> int:
    """Class of a word by how it ends: full stop, comma, other sign or neither, and its last two letters before that."""
    bare = word.rstrip(b".,;:!?)]}\"'*#%&$|-")
    last = word[-1:]
    ending = 0 if len(bare) == len(word) else 1 if last == b"." else 2 if last == b"," else 3
    code = 0
    for byte in bare[-2:]:
        code = code * 257 + byte + 1
    return ending * SUFFIXES + code * 2654435761 % 2**32 * SUFFIXES // 2**32


@dataclass
class Vocabulary:
    head: dict[bytes, tuple[int, int]]  # word to output and count
    outputs: int  # END, own words, then classes
    counts: np.ndarray  # training tokens of each output
    distinct: np.ndarray  # training words of each output
    unseen: np.ndarray  # estimated number of words of each output that training does not have
    tokens: int
    words: int

    def output_of(self, word: bytes) -> int:
        hit = self.head.get(word)
        return hit[0] if hit else self.outputs - CLASSES + shape_class(word)


def count_words(docs: DataFrame) -> DataFrame:
    """``word, n`` over all rows of ``text``; the end counts once for each row. Tasks combine before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for _, texts in chunks(batches, "text"):
            for text in texts:
                held.update(words_of(text))
            held[END] += len(texts)
            if len(held) > MOST_WORDS:
                yield from _counted(held)
                held = Counter()
        yield from _counted(held)

    return map_batches(docs.select("text"), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(held: Counter) -> Iterator[pa.RecordBatch]:
    words, numbers = list(held), list(held.values())
    for i in range(0, len(words), 50_000):
        column = pa.array(words[i : i + 50_000], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([column, pa.array(numbers[i : i + 50_000], pa.int64())], names=["word", "n"])


def build_vocabulary(counts: DataFrame) -> Vocabulary:
    """From the table of all counts: the commonest words, and totals of every output."""
    by_count = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.col("n").desc())
    threshold, held = None, 0
    for row in by_count.toLocalIterator():  # from the commonest down, until the head is full
        held += row["words"]
        if held > HEAD_WORDS:
            break
        threshold = row["n"]
    common = counts.where(F.col("n") >= threshold).collect() if threshold is not None else []
    ranked = sorted(((r["n"], r["word"].encode("utf-8")) for r in common), key=lambda r: (-r[0], r[1]))
    own = [w for _, w in ranked if w != END][:OUTPUT_WORDS]
    outputs = {w: i + 1 for i, w in enumerate(own)} | {END: 0}
    size = len(own) + 1 + CLASSES
    head = {w: (outputs.get(w, size - CLASSES + shape_class(w)), n) for n, w in ranked}
    head.setdefault(END, (0, 0))
    shared = counts.sparkSession.sparkContext.broadcast(outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, distinct, once, twice = np.zeros((4, size), dtype=np.int64)
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                word = word.encode("utf-8")
                at = shared.value.get(word)
                at = size - CLASSES + shape_class(word) if at is None else at
                tokens[at] += n
                distinct[at] += 1
                once[at] += n == 1
                twice[at] += n == 2
        at = np.flatnonzero(distinct)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(v[at]) for v in (tokens, distinct, once, twice))], names=["o", "n", "d", "f1", "f2"])

    totals = map_batches(counts, run, "o int, n long, d long, f1 long, f2 long").groupBy("o").agg(*[F.sum(c).alias(c) for c in ("n", "d", "f1", "f2")])
    n, d, f1, f2 = np.zeros((4, size), dtype=np.int64)
    for row in totals.collect():
        n[row["o"]], d[row["o"]], f1[row["o"]], f2[row["o"]] = row["n"], row["d"], row["f1"], row["f2"]
    return Vocabulary(head, size, n, d, unseen_words(f1, f2), int(n.sum()), int(d.sum()))


def unseen_words(once: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """Chao's estimate, from the words seen once and twice, at least one."""
    return np.maximum(once * (once - 1) / (2 * (twice + 1)), 1.0)


class LogBilinear:
    """Parameters and their updates. ``context`` rows: the outputs, then the start of a text."""

    def __init__(self, outputs: int, shares: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.noise = shares
        self.context, self.target = small(outputs + 1, DIMENSION), small(outputs, DIMENSION)
        self.bias = np.log(shares).astype(np.float32)
        self.normalisers: np.ndarray | None = None
        self.position = np.stack([np.eye(DIMENSION, dtype=np.float32)] * CONTEXT) / np.float32(CONTEXT)

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.context, self.target, self.bias, self.position]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    def load(self, flat: np.ndarray) -> LogBilinear:
        at = 0
        for part in self.parts:
            part[...] = flat[at : at + part.size].reshape(part.shape)
            at += part.size
        self.normalisers = None
        return self

    def predicted(self, before: np.ndarray) -> np.ndarray:
        """Predicted vectors from the outputs before (rows x CONTEXT)."""
        return sum(self.context[before[:, i]] @ self.position[i] for i in range(CONTEXT))

    def log_normaliser(self, before: np.ndarray) -> np.ndarray:
        """Log of the sum over all outputs for each row of contexts, by batched products."""
        out = np.empty(len(before), dtype=np.float64)
        for i in range(0, len(before), 2048):
            scores = self.predicted(before[i : i + 2048]) @ self.target.T
            scores += self.bias
            with np.errstate(over="ignore", divide="ignore"):
                found = np.log(np.exp(scores).sum(axis=1, dtype=np.float64))
            odd = np.flatnonzero(~np.isfinite(found))  # out of range: once more, less the largest
            if len(odd):
                top = scores[odd].max(axis=1)
                found[odd] = np.log(np.exp(scores[odd] - top[:, None]).sum(axis=1, dtype=np.float64)) + top
            out[i : i + 2048] = found
        return out

    def log_probability(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Normalised natural log probability of every token. The normaliser of a context is computed once and kept: a table of all
        contexts, 4 MB of 1,026 outputs and two places."""
        width = len(self.context)
        key = before[:, 0].astype(np.int64)
        for i in range(1, CONTEXT):
            key = key * width + before[:, i]
        if self.normalisers is None:
            self.normalisers = np.full(width**CONTEXT, np.nan, dtype=np.float32)
        scores = np.einsum("ij,ij->i", self.predicted(before), self.target[token]) + self.bias[token]
        known = self.normalisers[key]
        if not np.isnan(known).any():
            return scores.astype(np.float64) - known
        new, first = np.unique(key[np.isnan(self.normalisers[key])], return_index=True)
        if len(new):
            self.normalisers[new] = self.log_normaliser(before[np.isnan(self.normalisers[key])][first])
        return scores.astype(np.float64) - self.normalisers[key]

    def train(self, streams: Iterator[tuple[np.ndarray, np.ndarray]], seed: int) -> int:
        """Noise-contrastive updates by Adagrad; noise words are drawn once for a batch. Returns the tokens seen."""
        rng = np.random.default_rng(seed)
        sums = [np.full(p.shape, 1e-6, dtype=np.float32) for p in self.parts]
        cumulative = np.cumsum(self.noise)
        log_noise = np.log(NOISE * self.noise).astype(np.float32)
        seen, self.normalisers = 0, None
        for before, token in streams:
            order = rng.permutation(len(token))
            for i in range(0, len(order), BATCH):
                rows = order[i : i + BATCH]
                self._step(before[rows], token[rows], np.searchsorted(cumulative, rng.random(NOISE) * cumulative[-1]).clip(max=len(self.bias) - 1), log_noise, sums)
            seen += len(token)
        return seen

    def _step(self, before, token, noise, log_noise, sums) -> None:
        vectors = [self.context[before[:, i]] for i in range(CONTEXT)]
        predicted = sum(v @ p for v, p in zip(vectors, self.position))
        true, false = self.target[token], self.target[noise]
        # probability that a word is data, not noise
        data = _sigmoid(np.einsum("ij,ij->i", predicted, true) + self.bias[token] - log_noise[token]) - 1
        fake = _sigmoid(predicted @ false.T + (self.bias[noise] - log_noise[noise]))
        back = data[:, None] * true + fake @ false
        scale = np.float32(1 / len(token))
        gradient = np.stack([v.T @ back for v in vectors]) * scale
        into = np.concatenate([back @ p.T for p in self.position]) * scale
        targets = np.concatenate((data[:, None] * predicted, fake.T @ predicted)) * scale
        biases = np.concatenate((data, fake.sum(axis=0))) * scale
        rows, at = np.concatenate((token, noise)), before.T.ravel()
        _update(self.position, sums[3], slice(None), gradient)
        _update(self.context, sums[0], *_summed(at, into))
        both = _summed(rows, np.concatenate((targets, biases[:, None]), axis=1))
        _update(self.target, sums[1], both[0], both[1][:, :-1])
        _update(self.bias, sums[2], both[0], both[1][:, -1])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    with np.errstate(over="ignore"):  # an infinite exponential gives 0
        np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of their values."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    starts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    return rows[starts], np.add.reduceat(values[order], starts, axis=0)


def _update(part: np.ndarray, total: np.ndarray, rows, gradient: np.ndarray) -> None:
    total[rows] += gradient * gradient
    part[rows] -= np.float32(RATE) * gradient / np.sqrt(total[rows])


def _windows(lists: list[np.ndarray], start: int) -> tuple[np.ndarray, np.ndarray]:
    """Outputs before each token and the token, of all texts; ``start`` stands before a text."""
    pad = np.full(CONTEXT, start, dtype=np.int32)
    flat = np.concatenate([part for outputs in lists for part in (pad, outputs)])
    inside = np.concatenate([np.concatenate((np.zeros(CONTEXT, bool), np.ones(len(o), bool))) for o in lists])
    at = np.flatnonzero(inside)
    return np.stack([flat[at - CONTEXT + i] for i in range(CONTEXT)], axis=1), flat[at]


@dataclass
class Read:
    """The tokens of some texts, one after another, each text with its end."""

    sizes: np.ndarray  # tokens of each text
    places: np.ndarray  # in the head; -1 for other words
    outputs: np.ndarray
    rare: list[bytes]  # distinct words that are not in the head
    classes: np.ndarray  # their outputs
    rare_text: np.ndarray  # text, word (place in ``rare``) and number, by text
    rare_word: np.ndarray
    rare_times: np.ndarray


class _Reader:
    """Reads the words of texts as numbers: places in the head, and outputs. Shape classes of rarer words are kept."""

    def __init__(self, vocabulary: Vocabulary):
        self.place = {w: i for i, w in enumerate(vocabulary.head)}
        self.output = np.array([o for o, _ in vocabulary.head.values()], dtype=np.int32)
        self.first_class = vocabulary.outputs - CLASSES
        self.kept: dict[bytes, int] = {}

    def classes_of(self, words: list[bytes]) -> np.ndarray:
        if len(self.kept) > MOST_RARE:
            self.kept = {}
        for word in words:
            if word not in self.kept:
                self.kept[word] = self.first_class + shape_class(word)
        return np.fromiter(map(self.kept.__getitem__, words), dtype=np.int32, count=len(words))

    def read(self, texts: list[str]) -> Read:
        lists = [words_of(t) for t in texts]
        words = list(chain.from_iterable(lists))
        sizes = np.array([len(x) for x in lists], dtype=np.int64)
        found = np.fromiter(map(self.place.get, words, repeat(-1)), dtype=np.int32, count=len(words))
        missing = np.flatnonzero(found < 0)
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(words[i], len(number)) for i in missing.tolist()], dtype=np.int64)
        rare = list(number)
        classes = self.classes_of(rare)
        outputs = self.output[found]
        outputs[missing] = classes[ids]
        key, times = np.unique(np.repeat(np.arange(len(texts)), sizes)[missing] * max(1, len(rare)) + ids, return_counts=True)
        # the end after each text
        ends = np.cumsum(sizes + 1) - 1
        inside = np.ones(len(words) + len(texts), dtype=bool)
        inside[ends] = False
        places, all_outputs = np.full(len(inside), self.place[END], dtype=np.int32), np.zeros(len(inside), dtype=np.int32)
        places[inside], all_outputs[inside] = found, outputs
        return Read(sizes + 1, places, all_outputs, rare, classes, key // max(1, len(rare)), key % max(1, len(rare)), times)


def code_texts(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Of every row of ``row, id, held_out, text`` the outputs of its tokens (16 bits each), the sums that no context enters, and the words
    that are not in the head, with their numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary.__dict__)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(**shared.value)
        reader = _Reader(vocabulary)
        counts = np.array([n for _, n in vocabulary.head.values()], dtype=np.int64)
        in_class = reader.output >= reader.first_class
        # by place in the head, 0 for other words: known, log10 of count plus one, log10 of the share in the class
        known_at = np.append((counts > 0).astype(np.int64), 0)
        base_at = np.append(np.log10(counts + 1.0), 0.0)
        share_at = np.zeros(len(counts) + 1)
        share_at[:-1][in_class] = np.log10((counts[in_class] - DISCOUNT) / vocabulary.counts[reader.output[in_class]])
        for batch, texts in chunks(batches, "text", CODED_CHARS):
            read = reader.read(texts)
            starts = np.cumsum(read.sizes) - read.sizes
            known, base, share = (np.add.reduceat(v[read.places], starts) for v in (known_at, base_at, share_at))
            word, at = pa.array(read.rare, pa.binary()).cast(pa.string()), pa.array(read.rare_word)
            items = pa.StructArray.from_arrays([word.take(at), pa.array(read.classes).take(at), pa.array(read.rare_times.astype(np.int64))], names=["word", "o", "n"])
            rows = np.arange(len(texts) + 1)
            offsets = pa.array(np.searchsorted(read.rare_text, rows).astype(np.int32))
            outputs = read.outputs.astype("<u2").tobytes()
            cuts = np.append(starts, len(read.outputs)).astype(np.int32) * 2
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), batch.column(2), pa.array(read.sizes), pa.array(known, pa.int64()), pa.array(base, pa.float64()),
                    pa.array(share, pa.float64()), pa.ListArray.from_arrays(offsets, items),
                    pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(outputs)]),
                ],
                names=["row", "id", "held_out", "n_tokens", "known", "base", "share", "rare", "outputs"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    schema = f"row long, id {kind}, held_out boolean, n_tokens long, known long, base double, share double, rare array<struct<word: string, o: int, n: long>>, outputs binary"
    return map_batches(docs, run, schema)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batches with the outputs of their texts (last column), bounded in rows and tokens; a longer text stands alone."""
    for batch in batches:
        lists = [np.frombuffer(b, dtype="<u2").astype(np.int32) for b in batch.column(batch.num_columns - 1).to_pylist()]
        for start, end in slices(lists, CODED_TOGETHER):
            yield batch.slice(start, end - start), lists[start:end]


def train_model(coded: DataFrame, vocabulary: Vocabulary) -> LogBilinear:
    """One pass over all rows of ``outputs`` in ``ROUNDS`` parts; after each the tasks' parameters are averaged by tokens."""
    context = coded.sparkSession.sparkContext
    shares = (vocabulary.counts + 1) / (vocabulary.counts.sum() + vocabulary.outputs)
    model = LogBilinear(vocabulary.outputs, shares)
    size = vocabulary.outputs
    for turn in range(ROUNDS):
        start = context.broadcast(model.flat())

        def run(batches: Iterator[pa.RecordBatch], start=start, turn=turn) -> np.ndarray | None:
            local = LogBilinear(size, shares).load(start.value)
            streams = (_windows(lists, size) for _, lists in _coded(batches))
            seen = local.train(streams, seed=TaskContext.get().partitionId() * ROUNDS + turn)
            return np.append(local.flat().astype(np.float64) * seen, seen) if seen else None

        total = sum_arrays(coded.where(F.pmod(F.xxhash64("outputs"), F.lit(ROUNDS)) == turn).select("outputs"), run)
        start.destroy()
        if total is not None:
            model.load((total[:-1] / total[-1]).astype(np.float32))
    return model


def all_normalisers(spark, model: LogBilinear) -> np.ndarray:
    """Log normalisers of all pairs of words before a token, first word by first word in tasks: 4 MB of 1,026 contexts."""
    width = len(model.context)
    given = spark.sparkContext.broadcast((model.flat(), model.noise))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, noise = given.value
        model = LogBilinear(width - 1, noise).load(flat)
        for batch in batches:
            for first in batch.column(0).to_pylist():
                before = np.stack([np.full(width, first), np.arange(width)], axis=1)
                row = model.log_normaliser(before).astype(np.float32).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([row], pa.binary())], names=["first", "logs"])

    rows = sorted(map_batches(spark.range(0, width, 1, 12), run, "first long, logs binary").collect())
    given.destroy()
    return np.concatenate([np.frombuffer(r["logs"], dtype=np.float32) for r in rows])


def score_documents(df: DataFrame, text: str = "text", id_column: str = "doc_id", folds: int = 7, fold: int = 2) -> DataFrame:
    """One row per row: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    ``base_score`` is the add-one unigram, ``score`` the log-bilinear model, both as log10 of the whole text with its end. Rows with a
    null text count as empty; null and repeated ids are allowed and each row is scored alone. Without training rows both vocabularies
    are empty. An empty table gives an empty result.

    Texts are coded once with the broadcast head; rarer words are exploded and joined with the table of counts.
    Both sides of that join come from an exchange, so Spark splits a word that fills a partition.
    """
    has_columns(df, id_column, text)
    docs = df.select(F.col(f"`{id_column}`").alias("id"), held_out(id_column, folds, fold).alias("held_out"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    counts = materialize(count_words(docs.where("NOT held_out")), "word-counts")
    vocabulary = build_vocabulary(counts)
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "id", "held_out", "text")
    coded = materialize(code_texts(numbered, vocabulary), "coded")
    model = train_model(coded.where("NOT held_out"), vocabulary)
    shared = df.sparkSession.sparkContext.broadcast((model.flat(), model.noise, all_normalisers(df.sparkSession, model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, noise, normalisers = shared.value
        model = LogBilinear(len(noise), noise).load(flat)
        model.normalisers = normalisers
        for batch, lists in _coded(batches):
            starts = np.concatenate(([0], np.cumsum([len(o) for o in lists])[:-1]))
            logs = np.add.reduceat(model.log_probability(*_windows(lists, len(noise))), starts) / np.log(10)
            score = logs + batch.column(6).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(score)], names=["row", "id", "held_out", "n_tokens", "known", "base", "score"])

    kind = df.schema[id_column].dataType.simpleString()
    read = coded.select("row", "id", "held_out", "n_tokens", "known", "base", "share", "outputs")
    scored = map_batches(read, run, f"row long, id {kind}, held_out boolean, n_tokens long, known long, base double, score double")
    columns = zip(range(vocabulary.outputs), vocabulary.counts, vocabulary.distinct, vocabulary.unseen)
    classes = [(o, int(n), int(d), float(u)) for o, n, d, u in columns if o >= vocabulary.outputs - CLASSES]
    totals = F.broadcast(df.sparkSession.createDataFrame(classes, "o int, tokens long, words long, unseen double"))  # CLASSES rows
    items = coded.select("row", F.inline("rare"))
    found = items.join(counts.withColumnRenamed("n", "c"), "word", "left").join(totals, "o")
    seen = F.col("c").isNotNull()
    new_share = F.when(F.col("tokens") > 0, F.log10(F.lit(DISCOUNT) * F.col("words") / F.col("tokens") / F.col("unseen"))).otherwise(0.0)
    share = F.when(seen, F.log10((F.col("c") - F.lit(DISCOUNT)) / F.col("tokens"))).otherwise(new_share)
    rarely = found.groupBy("row").agg(
        F.sum(F.when(seen, F.col("n")).otherwise(0)).alias("more"),
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("more_base"),
        F.sum(F.col("n") * share).alias("more_score"),
    )
    whole = scored.join(rarely, "row", "left")
    unit = float(np.log10(vocabulary.tokens + vocabulary.words + 1))
    add = lambda name, more: F.col(name) + F.coalesce(F.col(more), F.lit(0))
    return whole.select(
        F.col("id").alias(id_column),
        "held_out",
        "n_tokens",
        add("known", "more").cast("long").alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (add("base", "more_base") - F.col("n_tokens") * F.lit(unit)).alias("base_score"),
        add("score", "more_score").alias("score"),
    )
