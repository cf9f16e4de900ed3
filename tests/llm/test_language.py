"""Language codes: codewords, held-out accuracy, odd rows."""

from __future__ import annotations

import random

import numpy as np
from ledgerlake.llm.language import CodeModel, accepted_documents, codewords, ngram_buckets, predict_languages
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.01"


def test_codewords():
    for n in (2, 4, 6, 20, 100):
        code = codewords(n).astype(int)
        assert len({tuple(r) for r in code}) == n
        assert (np.abs(code.sum(axis=0)) < n).all()  # every bit parts the languages
    four = codewords(4).astype(int)
    distances = [(four[i] != four[j]).sum() for i in range(4) for j in range(i)]
    assert four.shape == (4, 7) and min(distances) == 4
    assert codewords(0).shape == (0, 1) and codewords(1).shape == (1, 1)


def test_ngrams_are_those_of_each_word():
    buckets, starts = ngram_buckets(["ab", "c", "abc"])
    assert starts.tolist() == [0, 9, 15]  # of n characters with both ends: 3 (n + 2) - 3
    assert buckets[:9].tolist() == ngram_buckets(["ab"])[0].tolist() and len(buckets) == 27


def test_decoding_corrects_a_wrong_bit():
    model = CodeModel(["a", "b", "c", "d"], codewords(4), np.zeros((1, 7)), np.ones(7))
    for language in range(4):
        for wrong in range(7):
            margins = model.codes[language].astype(float)[None] * 5
            margins[0, wrong] *= -1
            best, score, gap = model.decode(margins)
            assert best[0] == language and 0.25 < score[0] <= 1 and gap[0] > 0
    assert model.decode(np.zeros((1, 7)))[2][0] == 0


def test_held_out_accuracy(spark):
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = predict_languages(frame).join(frame.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 200 and (got["lang"] == got["lang_pred"]).mean() > 0.98
    assert got["score"].between(0, 1).all()
    assert accepted_documents(frame).count() >= 0.99 * frame.count()


def test_odd_rows(rows):
    frame = rows(
        "doc_id LONG, text STRING, lang STRING, score STRING, held_out INT",
        (1, "the and of", "en", "x", 1), (None, None, "fr", "x", 1), (3, "123 ² _", "de", "x", 1), (4, "le la les des", "fr", "x", 1), (4, "le la les des", "fr", "x", 1),
        (5, "x" * 100_000, None, "x", 1), (6, "the", None, "x", 1), (7, "", None, "x", 1),
    )
    got = {(r["doc_id"], r["lang_pred"]) for r in predict_languages(frame).collect()}
    assert {(1, "en"), (None, "und"), (3, "und"), (4, "fr"), (6, "en"), (7, "und")} <= got
    kept = accepted_documents(frame)
    assert kept.columns == frame.columns and {1, 4, 6} <= {r["doc_id"] for r in kept.collect()} <= {1, 4, 5, 6}
    unlabelled = frame.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in predict_languages(unlabelled).collect()} == {"und"}
    assert accepted_documents(unlabelled).count() == 5
    assert predict_languages(frame.limit(0)).count() == 0 and accepted_documents(frame.limit(0)).count() == 0


def test_many_languages(rows, monkeypatch):
    """More labels than are fitted on the driver: the same model from sums over the bits."""
    from ledgerlake.llm import language

    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    data = []
    for lang in range(12):
        own = ["".join(rng.choice(letters[lang * 2 :] + letters[: lang * 2 : 3]) for _ in range(6)) for _ in range(30)]
        data += [(len(data) + i, " ".join(rng.choices(own, k=30)), f"l{lang:03d}") for i in range(12)]
    frame = rows("doc_id BIGINT, text STRING, lang STRING", *data).repartition(3)
    want = language.train(frame)
    monkeypatch.setattr(language, "MOST_LANGUAGES", 5)
    got = language.train(frame)
    assert got.languages == want.languages and np.array_equal(got.codes, want.codes)
    assert np.allclose(got.weights, want.weights, atol=1e-4) and np.allclose(got.trust, want.trust, atol=1e-4)
    monkeypatch.setattr(language, "DECODED_TOGETHER", 1000)
    assert [r["lang_pred"] for r in language.predict_languages(frame).where("held_out").collect()].count("und") == 0
    codes = language.codewords(2500)
    assert len({c.tobytes() for c in codes}) == 2500
