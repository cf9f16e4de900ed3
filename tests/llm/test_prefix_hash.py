"""Prefix hashes against slices of the texts."""

from __future__ import annotations

import random
from hashlib import sha256

from ledgerlake.llm import prefix_hash
from ledgerlake.llm.prefix_hash import BASES, Powers, PrefixHash, likeness, neighbour_fingerprints

FOLDER = "/root/testdata/sf0.001"
POWERS = [Powers(b) for b in BASES]


def drawn(rng, n=60):
    return "".join(rng.choice("abé日\x00😀") for _ in range(rng.randint(0, n)))


def test_spans_extensions_and_joins():
    rng = random.Random(3)
    for _ in range(300):
        a, b = drawn(rng), drawn(rng)
        x, y = PrefixHash.of(a, POWERS), PrefixHash.of(b, POWERS)
        i, j = rng.randint(0, len(a)), rng.randint(0, len(b))
        n = 0
        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
            n += 1
        assert x.extension(i, y, j) == n
        length = rng.randint(0, min(len(a) - i, len(b) - j))
        assert x.same(i, y, j, length) == (a[i : i + length] == b[j : j + length])
        keep, take = rng.randint(0, len(a)), rng.randint(0, len(b))
        joined, whole = x.joined(keep, y, take), PrefixHash.of(a[:keep] + b[:take], POWERS)
        assert all((p == q).all() for p, q in zip(joined.arrays, whole.arrays))


def test_likeness():
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    sketch = lambda t: (p := PrefixHash.of(t, POWERS)).fingerprint(p.spans())[1]
    other = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    assert likeness(sketch(text), sketch(text)) == 1 and likeness(sketch(text), sketch(other)) < 0.05
    assert likeness(sketch(text), sketch("new words first " + text)) > 0.95
    assert 0.6 < likeness(sketch(text), sketch(text[:3000] + other[:1000])) < 0.9
    assert likeness(sketch(""), sketch("")) == 1 and likeness(sketch(""), sketch("a")) == 0


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(prefix_hash, "ROWS_IN_BUCKET", 15)
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = sorted((r["doc_id"], r["text"]) for r in frame.collect())
    got = {r["doc_id"]: r for r in neighbour_fingerprints(frame.repartition(5)).collect()}
    assert len(got) == len(texts)
    for n, (i, text) in enumerate(texts):
        following = texts[(n + 1) % len(texts)][1]
        edited = text[: len(text) - len(text) // 4] + following[: len(text) // 4]
        fingerprint = lambda t: (p := PrefixHash.of(t, POWERS)).fingerprint(p.spans())[0]
        row = got[i]
        assert row["n_chars"] == len(text) and row["edited_sha256"] == sha256(edited.encode()).hexdigest()
        assert row["fingerprint"] == fingerprint(text) and row["edited_fingerprint"] == fingerprint(edited)
        common = next((k for k, (x, y) in enumerate(zip(text, edited)) if x != y), min(len(text), len(edited)))
        assert row["common_prefix_edited"] == common
    by_text = {}
    for i, text in texts:
        assert by_text.setdefault(text, got[i]["fingerprint"]) == got[i]["fingerprint"]
    assert len(set(by_text.values())) == len(by_text)


def test_odd_rows(rows, monkeypatch):
    monkeypatch.setattr(prefix_hash, "ROWS_IN_BUCKET", 1)
    frame = rows("doc_id LONG, text STRING, h INT, bucket STRING", (1, "a" * 40, 1, "x"), (1, "a" * 40, 1, "x"), (None, None, 1, "x"), (2, "", 1, "x"), (3, "é" * 5, 1, "x"), (None, "xyz" * 9, 1, "x"), (9, "long " * 60_000, 1, "x"))
    got = neighbour_fingerprints(frame).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"]) for r in got) == [("1", 40), ("1", 40), ("2", 0), ("3", 5), ("9", 300_000), ("None", 0), ("None", 27)]
    assert neighbour_fingerprints(frame.limit(0)).count() == 0
    alone = neighbour_fingerprints(rows("doc_id LONG, text STRING", (1, "abcdefgh"))).first()
    assert alone["edited_sha256"] == sha256(b"abcdefab").hexdigest() and alone["near_next"] == 1
