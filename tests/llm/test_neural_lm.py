"""Scores: exact counts, probabilities that add up, gradients, and held-out gain."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from ledgerlake.llm import neural_lm
from ledgerlake.llm.neural_lm import CLASSES, CONTEXT, LogBilinear, Vocabulary, score_documents, shape_class

FOLDER = "/root/testdata/sf0.01"


def test_log_probabilities_are_normalised():
    rng = np.random.default_rng(1)
    shares = rng.random(40)
    model = LogBilinear(40, shares / shares.sum())
    before = rng.integers(0, 41, (5, CONTEXT))
    logs = np.array([model.log_probability(before, np.full(5, t)) for t in range(40)])
    assert np.exp(logs).sum(axis=0) == pytest.approx(np.ones(5), abs=1e-5)


def test_training_learns_what_follows():
    rng = np.random.default_rng(2)
    model = LogBilinear(20, np.full(20, 0.05))
    tokens = np.cumsum(rng.integers(1, 3, 40_000)) % 20  # each step is one or two
    before = np.stack([tokens[:-2], tokens[1:-1]], axis=1)
    model.train(iter([(before, tokens[2:])] * 6), seed=1)
    assert model.log_probability(before, tokens[2:]).mean() > math.log(0.3)  # 1/2 at best, 1/20 before


def test_classes_of_any_word():
    assert all(0 <= shape_class(w.encode()) < CLASSES for w in ["a", "...", "tion.", "é", "日本", "x" * 1000])
    vocabulary = Vocabulary({b" ": (0, 3)}, CLASSES + 1, *np.zeros((3, CLASSES + 1)), 3, 1)
    assert vocabulary.output_of(b" ") == 0 and vocabulary.output_of(b"tion.") == 1 + shape_class(b"tion.")


def tokens_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + [" "]


@pytest.mark.parametrize("head", [100_000, 300])
def test_counts_and_scores(spark, monkeypatch, head):
    monkeypatch.setattr(neural_lm, "HEAD_WORDS", head)
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 400").repartition(3)
    texts = {r["doc_id"]: tokens_of(r["text"]) for r in frame.collect()}
    train = {i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2}
    counts = Counter(w for i in train for w in texts[i])
    total, distinct = sum(counts.values()), len(counts)
    got = score_documents(frame).collect()
    assert len(got) == len(texts)
    for r in got:
        words = texts[r["doc_id"]]
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (r["doc_id"] not in train, len(words), sum(w in counts for w in words), total)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def _vocabulary_and_model(monkeypatch, frame):
    """What the operator builds, kept while it runs."""
    kept = {}
    build, train = neural_lm.build_vocabulary, neural_lm.train_model
    monkeypatch.setattr(neural_lm, "build_vocabulary", lambda counts: kept.setdefault("vocabulary", build(counts)))
    monkeypatch.setattr(neural_lm, "train_model", lambda coded, vocabulary: kept.setdefault("model", train(coded, vocabulary)))
    got = score_documents(frame).collect()
    return got, kept["vocabulary"], kept["model"]


def _brute_score(words, counts, vocabulary, model):
    """log10 probability of a text, token by token: softmax over all outputs, times the share in the class."""
    first_class = vocabulary.outputs - CLASSES
    of_class = Counter()
    seen = {}
    for w, n in counts.items():
        o = vocabulary.output_of(w.encode())
        of_class[o] += n
        seen.setdefault(o, Counter())[n] += 1
    before, total = [vocabulary.outputs] * CONTEXT, 0.0
    for w in words:
        o = vocabulary.output_of(w.encode())
        vector = sum(model.context[b].astype(np.float64) @ model.position[i] for i, b in enumerate(before))
        scores = model.target.astype(np.float64) @ vector + model.bias
        total += (scores[o] - np.log(np.exp(scores).sum())) / math.log(10)
        if o >= first_class and of_class[o]:
            numbers = seen[o]
            unseen = max(numbers[1] * (numbers[1] - 1) / (2 * (numbers[2] + 1)), 1.0)
            share = counts[w] - 0.75 if counts[w] else 0.75 * sum(numbers.values()) / unseen
            total += math.log10(share / of_class[o])
        before = [*before[1:], o]
    return total


@pytest.mark.parametrize("head, own", [(100_000, 768), (200, 50)])
def test_scores_equal_brute_force(spark, monkeypatch, head, own):
    monkeypatch.setattr(neural_lm, "HEAD_WORDS", head)
    monkeypatch.setattr(neural_lm, "OUTPUT_WORDS", own)
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 120 AND length(text) < 4000").repartition(3)
    texts = {r["doc_id"]: tokens_of(r["text"]) for r in frame.collect()}
    counts = Counter(w for i in texts if zlib.crc32(str(i).encode()) % 7 != 2 for w in texts[i])
    got, vocabulary, model = _vocabulary_and_model(monkeypatch, frame)
    picked = [r for r in got if r["doc_id"] % 3 == 0]
    assert len(picked) > 20
    for r in picked:
        assert r["score"] == pytest.approx(_brute_score(texts[r["doc_id"]], counts, vocabulary, model), rel=1e-4)


def test_shares_in_a_class_add_up(spark, monkeypatch):
    """All known words of every class and the estimated number of unknown ones: the shares of a class are one."""
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 300")
    texts = {r["doc_id"]: tokens_of(r["text"]) for r in frame.collect()}
    counts = Counter(w for i in texts if zlib.crc32(str(i).encode()) % 7 != 2 for w in texts[i])
    _, vocabulary, _ = _vocabulary_and_model(monkeypatch, frame)
    sums, checked = Counter(), 0
    for w, n in counts.items():
        sums[vocabulary.output_of(w.encode())] += n - 0.75
    for o in range(vocabulary.outputs - CLASSES, vocabulary.outputs):
        if vocabulary.counts[o]:
            reserved = vocabulary.unseen[o] * (0.75 * vocabulary.distinct[o] / vocabulary.counts[o] / vocabulary.unseen[o])
            assert sums[o] / vocabulary.counts[o] + reserved == pytest.approx(1)
            checked += 1
    assert checked > 50 and vocabulary.unseen.max() > 20


def test_unseen_words():
    assert neural_lm.unseen_words(np.array([0, 1, 10, 100]), np.array([0, 0, 4, 0])).tolist() == [1.0, 1.0, 9.0, 4950.0]


def test_odd_rows(rows):
    frame = rows("doc_id LONG, text STRING, score INT, row STRING", (1, "the and of", 1, "x"), (None, None, 1, "x"), (3, "", 1, "x"), (3, "the", 1, "x"), (3, "the", 1, "x"), (5, "long " * 50_000, 1, "x"))
    got = score_documents(frame).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == [("1", 4), ("3", 1), ("3", 2), ("3", 2), ("5", 50_001), ("None", 1)]
    assert all(r["score"] <= 0 and r["base_score"] <= 0 for r in got)
    assert score_documents(frame.limit(0)).count() == 0
    only_held_out = score_documents(rows("doc_id LONG, text STRING", (1, "the and of")))  # crc32 of 1 leaves 2
    row = only_held_out.first()
    assert (row["held_out"], row["n_known"], row["train_tokens"], row["base_score"]) == (True, 0, 0, 0.0)
