"""Alignment of two tokenizers against the vocabularies' own library and a brute-force count."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
import sentencepiece
from ledgerlake.llm.alignment import VocabularyPair, align, align_tokenizers
from ledgerlake.llm.queries import byte_level_path, model_path
from tokenizers import Tokenizer

TEXTS = [
    None, "", " ", "the same row", "the same row", "▁ is changed", "<|endoftext|></s><s> <unk> <0x0A>", "日本語 テスト 😀😀", "á é\tñ\r\n\r\n  x  ",
    "x" * 3000, " " * 2000, "\n" * 50, "don't we'll 1234567 1.5e-7 ();;;", "\x00\x01", "internationalisation" * 20, "a", "  the", "the  ", "it's  so",
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(byte_level_path())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=model_path())


@pytest.fixture(scope="module")
def vocabularies():
    with open(byte_level_path(), "rb") as a, open(model_path(), "rb") as b:
        return VocabularyPair(a.read(), b.read())


def _tokens(libraries, text):
    """Ids and bytes of both sides by the libraries; empty where a side changes the text."""
    a, b = libraries
    if not text:
        return [], [], [], []
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    letters = {}
    hidden = 0
    for byte in range(256):
        if 0x21 <= byte <= 0x7E or 0xA1 <= byte <= 0xAC or byte >= 0xAE:
            letters[chr(byte)] = byte
        else:
            letters[chr(0x100 + hidden)] = byte
            hidden += 1
    bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if {b"".join(bytes_a), b"".join(bytes_b)} != {(" " + text).encode()}:
        return [], [], [], []
    return ids_a, ids_b, bytes_a, bytes_b


def _spans(parts):
    out, at = [], 0
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def _brute(libraries, texts):
    links, shown = [], []
    for text in texts:
        ids_a, ids_b, bytes_a, bytes_b = _tokens(libraries, text)
        a, b = _spans(bytes_a), _spans(bytes_b)
        found, low = [], 0
        for i, (start, end) in enumerate(a):
            while low < len(b) and b[low][1] <= start:
                low += 1
            j = low
            while j < len(b) and b[j][0] < end:
                found.append((ids_a[i], ids_b[j]))
                j += 1
        links.append(found)
        cuts = sorted({e for _, e in a} & {e for _, e in b})
        groups, before = [], 0
        for cut in cuts:
            side = [",".join(str(x) for x, (s, e) in zip(ids, spans) if before <= s and e <= cut) for ids, spans in ((ids_a, a), (ids_b, b))]
            groups.append("|".join(side))
            before = cut
        shown.append((len(ids_a), len(ids_b), len(cuts), sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    count = Counter(p for found in links for p in set(found))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return [(n_a, n_b, n_groups, len(f), sum(count[p] == best[p[0]] for p in f), sum(count[p] for p in f), digest) for (n_a, n_b, n_groups, digest), f in zip(shown, links)]


def _texts():
    rng = random.Random(5)
    letters = [*"abcdehinorst    ▁éñ.\n\r\t;()0189日", "the", "ing", " of", "'s", "  "]
    return TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randint(1, rng.choice([5, 40, 300])))) for _ in range(150)]


def test_equals_brute_force(spark, rows, libraries):
    texts = _texts()
    frame = rows("doc_id BIGINT, text STRING, n_a INT, block STRING", *[(i if i % 7 else None, t, 1, "b") for i, t in enumerate(texts)]).repartition(5)
    got = align_tokenizers(frame, byte_level_path(), model_path())
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = Counter((i if i % 7 else None, *row) for i, row in enumerate(_brute(libraries, texts)))
    assert Counter(tuple(r) for r in got.collect()) == want


def test_ids_are_those_of_the_library(libraries, vocabularies):
    for text in _texts():
        if text:
            assert vocabularies.a.encode_ordinary(" " + text) == libraries[0].encode(" " + text, add_special_tokens=False).ids
    assert vocabularies.a_bytes[libraries[0].token_to_id("Ġthe")] == b" the"
    for a, b in enumerate(vocabularies.same.tolist()):
        assert b < 0 or vocabularies.a_bytes[a] == vocabularies.b_bytes[b]


def test_blocks_of_nothing(vocabularies):
    assert align(vocabularies, []).digests == []
    made = align(vocabularies, ["", "▁", ""])
    assert made.digests == ["", "", ""] and made.n_a.tolist() == [0, 0, 0] and made.ends.tolist() == [0, 0, 0] and len(made.codes) == 0


def test_empty_table_and_text_ids(rows):
    frame = rows("doc_id STRING, text STRING", ("x", "some text"), (None, None))
    assert align_tokenizers(frame.limit(0), byte_level_path(), model_path()).count() == 0
    assert {r["doc_id"]: r["n_groups"] > 0 for r in align_tokenizers(frame, byte_level_path(), model_path()).collect()} == {"x": True, None: False}
