"""Language ID by error-correcting output codes.

Every language has a codeword. For each bit a binary classifier over hashed character n-grams (one to three characters, word ends
included) is learned from n-gram counts of all training documents. A text is decoded to the codeword of least weighted logistic
loss; nearly equal losses mark it as ambiguous.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import has_columns, map_batches, materialize, ship_package, slices, sum_arrays

UNDETERMINED = "und"
BUCKETS = 1 << 14
SMOOTHING = 0.5
#: Up to so many languages the counts of each reach the driver; of more languages only sums over those that share a bit do.
MOST_LANGUAGES = 256
#: All splits of the languages are used as bits up to this number of languages, else random codes.
EXHAUSTIVE = 6
#: A text is ambiguous if the second codeword loses by less than this.
AMBIGUOUS_GAP = 0.05
#: N-grams of a text overlap, so their log odds are scaled before the loss.
TEMPERATURE = 3.0
MOST_WORDS = 250_000
#: Losses (text x language x bit) held at once.
DECODED_TOGETHER = 4_000_000
#: Beyond so many languages one random code is taken as it is; its bits make two alike improbable.
COMPARED = 2000
LONG_WORD = 48

_words = re.compile(r"[^\W\d_]+").findall


def words_of(text: str) -> list[str]:
    return _words(text.lower())


def has_letter(words: list[str]) -> bool:
    return any(map(str.isalpha, words)) or any(c.isalpha() for w in words for c in w)


def ngram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram, and where each word's begin; words in order, each with its end marks."""
    codes = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    owner = np.repeat(np.arange(len(words)), lengths)
    a, m = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
    shift = np.uint64(64 - int(math.log2(BUCKETS)))
    one = codes + np.uint64(1)
    two = one[:-1] * a + one[1:]
    three = two[:-1] * a + one[2:]
    parts, owners = [], []
    for n, values in enumerate((one, two, three), 1):
        inside = owner[: len(values)] == owner[n - 1 :]
        parts.append(((values[inside] * np.uint64(2 * n + 1) * m) >> shift).astype(np.int32))
        owners.append(owner[: len(values)][inside])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    starts = np.concatenate(([0], np.cumsum(np.bincount(owners, minlength=len(words)))[:-1]))
    return np.concatenate(parts)[order], starts


def codewords(n: int) -> np.ndarray:
    """``n`` rows of +1 and -1. Few languages: every split of them. Many: of 200 random codes that with the largest least distance."""
    if n <= 1:
        return np.ones((n, 1), dtype=np.int8)
    if n <= EXHAUSTIVE:
        splits = range(1, 2 ** (n - 1))
        return np.array([[1 if i and s >> (i - 1) & 1 else -1 for s in splits] for i in range(n)], dtype=np.int8)
    rng, best, found = np.random.default_rng(5), -1, None
    bits = math.ceil(10 * math.log2(n))
    for _ in range(200 if n <= COMPARED else 1):
        code = rng.choice(np.array([-1, 1], dtype=np.int8), size=(n, bits))
        code = code[:, np.abs(code.sum(axis=0)) < n]  # a bit that is the same everywhere tells nothing
        if n > COMPARED:
            return code
        distance = (code.shape[1] - code.astype(int) @ code.T.astype(int)) // 2
        least = int((distance + np.eye(n, dtype=int) * bits).min())
        if least > best:
            best, found = least, code
    return found


@dataclass
class CodeModel:
    languages: list[str]
    codes: np.ndarray  # language x bit
    weights: np.ndarray  # bucket x bit: log odds of an n-gram for the bit
    trust: np.ndarray  # weight of each bit's loss

    @classmethod
    def fit(cls, languages: list[str], counts: np.ndarray) -> CodeModel:
        """``counts``: language x bucket. Languages weigh alike, whatever their share of the documents."""
        codes = codewords(len(languages))
        share = (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
        if len(languages) < 2:
            return cls(languages, codes, np.zeros((BUCKETS, 1), dtype=np.float32), np.ones(1, dtype=np.float32))
        sides = [np.stack([share[bit == sign].mean(axis=0) for bit in codes.T], axis=1) for sign in (1, -1)]
        return cls.of_sides(languages, codes, *sides)

    @classmethod
    def of_sides(cls, languages: list[str], codes: np.ndarray, on: np.ndarray, off: np.ndarray) -> CodeModel:
        """``on`` and ``off``: mean share of each bucket (row) among the languages with and without a bit (column)."""
        odds = np.log(on) - np.log(off)
        trust = (np.abs(odds) * (on + off)).sum(axis=0) / 2  # how far an n-gram tells both sides apart on average
        return cls(languages, codes, odds.astype(np.float32), (trust / trust.mean()).astype(np.float32))

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row: nearest codeword, its share among all (0 to 1), and by how much the second loses."""
        together = max(1, DECODED_TOGETHER // self.codes.size)
        if len(margins) > together:
            parts = [self.decode(margins[i : i + together]) for i in range(0, len(margins), together)]
            return tuple(np.concatenate(column) for column in zip(*parts))
        signed = margins[:, None, :] * self.codes[None, :, :] / TEMPERATURE
        loss = (np.logaddexp(0, -signed) * self.trust).sum(axis=2) / max(1, self.codes.shape[1] / 2)
        best = loss.argmin(axis=1)
        least = loss.min(axis=1)
        score = 1 / np.exp(np.maximum(least[:, None] - loss, -700)).sum(axis=1)
        gap = np.sort(loss, axis=1)[:, 1] - least if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        return best, score, gap


class Decoder:
    """Margins of texts; a word's sum of log odds is computed once and kept."""

    def __init__(self, model: CodeModel):
        self.model = model
        self._empty()

    def _empty(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, self.model.weights.shape[1]), dtype=np.float32)

    def _score(self, words: list[str]) -> np.ndarray:
        buckets, starts = ngram_buckets(words)
        return np.add.reduceat(self.model.weights[buckets], starts, axis=0)

    def _learn(self, words: list[str]) -> None:
        for i in range(0, len(words), 20_000):
            block = words[i : i + 20_000]
            at = len(self.known)
            while at + len(block) > len(self.rows):
                self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
            self.rows[at : at + len(block)] = self._score(block)
            self.known.update(zip(block, range(at, at + len(block))))

    def margins(self, texts_words: list[list[str]]) -> np.ndarray:
        if len(self.known) > MOST_WORDS:
            self._empty()
        new = set().union(*texts_words)
        new = [w for w in new if w not in self.known]
        short = [w for w in new if len(w) <= LONG_WORD]
        long = {w: self._score([w])[0] for w in new if len(w) > LONG_WORD}
        self._learn(short)
        out = np.zeros((len(texts_words), self.model.weights.shape[1]), dtype=np.float64)
        for i, words in enumerate(texts_words):
            if long:
                for w in words:
                    if w in long:
                        out[i] += long[w]
                words = [w for w in words if w not in long]
            if words:
                at = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
                out[i] += self.rows[at].sum(axis=0, dtype=np.float64)
        return out

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, score and ambiguity of each text."""
        words = [words_of(t) if t else [] for t in texts]
        if not self.model.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts), [True] * len(texts)
        best, score, gap = self.model.decode(self.margins(words))
        told = [has_letter(w) for w in words]
        names = [self.model.languages[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), told)]
        return names, [s if ok else 0.0 for s, ok in zip(score.tolist(), told)], [not ok or g < AMBIGUOUS_GAP for ok, g in zip(told, gap.tolist())]


def train(df: DataFrame, text: str = "text", lang: str = "lang") -> CodeModel:
    """Learn from all rows with a text and a language: n-gram counts per language, summed by Spark.

    A task sends at most one count per language and bucket and flush; only the sums reach the driver.
    """
    has_columns(df, text, lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for language, counter in held.items():
                totals = np.zeros(BUCKETS, dtype=np.int64)
                words, numbers = list(counter), np.fromiter(counter.values(), dtype=np.int64, count=len(counter))
                for i in range(0, len(words), 20_000):
                    buckets, starts = ngram_buckets(words[i : i + 20_000])
                    per = np.diff(np.append(starts, len(buckets)))
                    totals += np.bincount(buckets, np.repeat(numbers[i : i + 20_000], per), BUCKETS).astype(np.int64)
                at = np.flatnonzero(totals)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([language] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(totals[at], pa.int64())], names=["lang", "bucket", "n"]
                )

        for batch in batches:
            for value, language in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(value)
                counter = held.setdefault(language, Counter())
                size -= len(counter)
                counter.update(words)
                size += len(counter)
                if size > MOST_WORDS:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    rows = df.where(F.col(f"`{text}`").isNotNull() & F.col(f"`{lang}`").isNotNull()).select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    summed = map_batches(rows, run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    summed = materialize(summed, "language-counts")
    totals = dict(summed.groupBy("lang").agg(F.sum("n")).collect())  # one number for each label
    languages = sorted(totals)
    if len(languages) > MOST_LANGUAGES:
        return _fit_many(summed, languages, totals)
    table = summed.toPandas()  # MOST_LANGUAGES x BUCKETS rows at most
    counts = np.zeros((len(languages), BUCKETS))
    at = {name: i for i, name in enumerate(languages)}
    counts[[at[name] for name in table["lang"]], table["bucket"].to_numpy()] = table["n"].to_numpy()
    return CodeModel.fit(languages, counts)


def _fit_many(summed: DataFrame, languages: list[str], totals: dict[str, int]) -> CodeModel:
    """The same model from sums over the languages of each bit, made in the tasks: their size depends on the number of bits alone."""
    codes = codewords(len(languages))
    at = {name: i for i, name in enumerate(languages)}
    size = np.array([totals[name] for name in languages]) + SMOOTHING * BUCKETS
    given = summed.sparkSession.sparkContext.broadcast((at, size, codes))

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        at, size, codes = given.value
        sums = np.zeros((2, BUCKETS, codes.shape[1]))
        for batch in batches:
            owner = np.array([at[name] for name in batch.column(0).to_pylist()], dtype=np.int64)
            bucket, share = batch.column(1).to_numpy(), batch.column(2).to_numpy() / size[owner]
            for side, sign in enumerate((1, -1)):
                for bit in range(codes.shape[1]):
                    of_side = codes[owner, bit] == sign
                    sums[side, :, bit] += np.bincount(bucket[of_side], share[of_side], BUCKETS)
        return sums.ravel()

    sums = sum_arrays(summed.select("lang", "bucket", "n"), run).reshape(2, BUCKETS, -1)
    given.destroy()
    rest = SMOOTHING / size
    means = [(sums[side] + (rest[:, None] * (codes == sign)).sum(axis=0)) / (codes == sign).sum(axis=0) for side, sign in enumerate((1, -1))]
    return CodeModel.of_sides(languages, codes, *means)


def language_of(df: DataFrame, model: CodeModel, text: str = "text") -> Column:
    """A struct column ``lang, score, ambiguous`` of each whole text. Nothing is shuffled."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model.__dict__)

    @F.pandas_udf("lang string, score double, ambiguous boolean")
    def judged(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        decoder = Decoder(CodeModel(**shared.value))
        for series in parts:
            values = series.tolist()
            out: tuple[list, list, list] = ([], [], [])
            for start, end in slices([v or "" for v in values]):
                for column, more in zip(out, decoder.judge(values[start:end])):
                    column.extend(more)
            yield pd.DataFrame({"lang": out[0], "score": out[1], "ambiguous": out[2]})

    return judged(F.col(f"`{text}`"))


def held_out(id_column: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("")).cast("binary")) % folds == fold


def predict_languages(df: DataFrame, text: str = "text", lang: str = "lang", id_column: str = "doc_id", folds: int = 4, fold: int = 2) -> DataFrame:
    """One row per row: id, ``held_out``, ``lang_pred``, ``score``, ``ambiguous``; learned from the rows that are not held out.

    A text that is null or has no letter gives ``und`` with score 0. So does every text if no training row has a language. Only the
    text enters a prediction. Ids may be null or repeated; an empty table gives an empty result.
    """
    has_columns(df, id_column, text, lang)
    out = held_out(id_column, folds, fold)
    model = train(df.where(~out), text, lang)
    judged = df.select(F.col(f"`{id_column}`").alias("_id"), out.alias("held_out"), language_of(df, model, text).alias("_made"))
    return judged.select(
        F.col("_id").alias(id_column), "held_out", F.col("_made.lang").alias("lang_pred"), F.col("_made.score").alias("score"), F.col("_made.ambiguous").alias("ambiguous")
    )


def accepted_documents(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows whose language is told, with the columns of ``df``: those without text or letter and those between two codewords go.

    Learned from all labelled rows of ``df``. If there is none, only rows without a letter go.
    """
    model = train(df, text, lang)
    if not model.languages:
        return df.where(F.coalesce(F.col(f"`{text}`"), F.lit("")).rlike(r"\p{L}"))
    return df.where(~language_of(df, model, text)["ambiguous"])
