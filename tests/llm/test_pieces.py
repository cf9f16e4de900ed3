"""SentencePiece coding and the length histogram against the library and brute force."""

from __future__ import annotations

import random
from collections import Counter
from hashlib import sha256

import pytest
import sentencepiece
from ledgerlake.llm.pieces import PieceCoder, PieceTables, encode_pieces, piece_digests, piece_lengths
from ledgerlake.llm.queries import model_path
from ledgerlake.llm.token_lengths import length_histogram

TEXTS = [
    None, "", " ", "  ", "   \n  a", "▁x", " ▁▁ y", "<0x0A><s></s><unk>", "x" * 300, " " * 1000, "\x00", "日本語 テスト", "á é ñ", "ab" * 200 + " " * 77 + "the" * 99,
    "😀😀 a", "\r\n\r\n();\r\n", "1234567 1.5", "the same row", "the same row",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=model_path())


@pytest.fixture(scope="module")
def coder():
    return PieceCoder(PieceTables.load(model_path()))


def test_encodes_and_decodes_as_the_library(library, coder):
    rng = random.Random(1)
    letters = [*"abcdehinorst    ▁éñ.\n\r\t;()0189日", "the", "ing", " of"]
    texts = [t for t in TEXTS if t] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, rng.choice([5, 40, 400])))) for _ in range(600)]
    for text in texts:
        want = library.encode(text)
        assert coder.encode(text) == want
        assert [i for p in coder.parts(text) for i in coder.merge_by_heap(p)] == want  # the form for long parts
        assert coder.decode([*want, 2]) == library.decode([*want, 2])


def test_decodes_any_ids(library, coder):
    rng = random.Random(2)
    for _ in range(300):
        ids = [rng.choice([rng.randint(3, 258), rng.randint(1, 31_999)]) for _ in range(12)]
        assert coder.decode(ids) == library.decode(ids)


def test_digests(spark, rows, library):
    frame = rows("doc_id BIGINT, text STRING, n_tokens INT", *[(i if i % 5 else None, t, 1) for i, t in enumerate(TEXTS)])
    got = Counter(tuple(r) for r in piece_digests(frame, model_path()).collect())
    want = Counter()
    for i, text in enumerate(TEXTS):
        ids = library.encode(text or "") + [2]
        digest = lambda s: sha256(s.encode()).hexdigest()
        want[(i if i % 5 else None, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids)))] += 1
    assert got == want
    assert piece_digests(frame.limit(0), model_path()).count() == 0


def test_encode_keeps_columns(rows, library):
    frame = rows("doc_id BIGINT, text STRING, ids STRING, other INT", (1, "the text", "taken", 3), (2, None, None, None))
    got = {r["doc_id"]: r for r in encode_pieces(frame, model_path()).collect()}
    assert list(got[1].asDict()) == ["doc_id", "text", "other", "ids", "decoded"]
    assert got[1]["ids"] == library.encode("the text") + [2] and got[1]["decoded"] == "the text"
    assert got[2]["ids"] == [2] and got[2]["decoded"] == ""


def test_histogram(rows, library):
    frame = rows("text STRING", *[(t,) for t in TEXTS])
    sizes = [len(library.encode(t or "")) + 1 for t in TEXTS]
    assert sorted(r[0] for r in piece_lengths(frame, model_path()).collect()) == sorted(sizes)
    many = sizes + [9000, 9000, 20_000]
    got = {r["n_tokens"]: r for r in length_histogram(rows("n_tokens LONG", *[(n,) for n in many], (None,))).collect()}
    assert set(got) == set(many)
    for n, row in got.items():
        assert row["docs"] == many.count(n) and row["tokens"] == n * many.count(n)
        assert row["docs_from"] == sum(m >= n for m in many) and row["tokens_from"] == sum(m for m in many if m >= n)
        assert row["docs_upto"] == sum(m <= n for m in many) and row["quantile"] == pytest.approx(sum(m <= n for m in many) / len(many))
        assert row["truncated_total"] == sum(min(m, n) for m in many)
    assert length_histogram(rows("n_tokens LONG", (1,)).limit(0)).count() == 0
