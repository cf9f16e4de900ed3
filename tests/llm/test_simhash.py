"""SimHash classes against a comparison of all pairs."""

from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash
from ledgerlake.llm import simhash as module
from ledgerlake.llm.components import connected_components
from ledgerlake.llm.simhash import keep_first_of_groups, near_duplicate_classes, simhash

FOLDER = "/root/testdata/sf0.001"


def plain(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints):
    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], dtype=np.uint64)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[k]) <= 2):
            a, b = find(i), find(ids[j])
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_fingerprint(monkeypatch):
    monkeypatch.setattr(module, "COUNTED_TOGETHER", 3)
    for text in ["", " \t", "One", "ONE two", "Ünï a\u00a0b c d", "a b c d e f g h i j k"]:
        assert simhash(text) % 2**64 == plain(text)


def test_classes_equal_all_pairs(documents):
    prints = {r["doc_id"]: plain(r["text"]) for r in documents.collect()}
    want = classes(prints)
    got = near_duplicate_classes(documents).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{f:016x}", want[i]) for i, f in prints.items()}
    assert sorted(r["doc_id"] for r in keep_first_of_groups(documents).collect()) == sorted(set(want.values()))


def test_chains_of_fingerprints(spark, rows):
    """Made-up fingerprints: chains at one and two bits, hubs and loners."""
    rng = np.random.default_rng(3)
    values = {int(v) for v in rng.integers(-(2**63), 2**63 - 1, 40)}
    for start in list(values)[:10]:
        for _ in range(12):
            for b in rng.integers(0, 63, rng.integers(1, 3)):
                start ^= 1 << int(b)
            values.add(start)
    prints = {i: v % 2**64 for i, v in enumerate(sorted(values))}
    frame = rows("fp LONG, doc_id LONG", *[(v, i) for i, v in enumerate(sorted(values))])
    got = module._first_of_fingerprints(frame, 2, "doc_id").collect()
    want = classes(prints)
    number = {v: i for i, v in enumerate(sorted(values))}
    assert {number[r["fp"]]: r["component_id"] for r in got} == want


def test_odd_rows(rows):
    frame = rows(
        "doc_id LONG, text STRING, fp INT, component_id STRING",
        (1, "a b c d", 1, "x"), (1, "a b c d", 1, "x"), (None, "x y z w", 1, "x"), (None, "x y z w", 1, "x"), (2, None, 1, "x"), (3, "", 1, "x"), (None, "", 1, "x"),
        (1, "other words here now", 1, "x"), (5, "other words here now", 1, "x"), (9, "long " * 50_000, 1, "x"),
    )
    got = sorted(((r["doc_id"], r["component_id"]) for r in near_duplicate_classes(frame).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (1, 1), (5, 1), (2, 2), (3, 2), (None, 2), (None, None), (None, None), (9, 9)], key=str)
    kept = keep_first_of_groups(frame)
    assert kept.columns == frame.columns
    assert sorted((str(r["doc_id"]), (r["text"] or "")[:5]) for r in kept.collect()) == [("1", "a b c"), ("1", "other"), ("2", ""), ("9", "long "), ("None", "x y z")]
    assert near_duplicate_classes(frame.limit(0)).count() == 0 and keep_first_of_groups(frame.limit(0)).count() == 0


def test_components(rows):
    edges = rows("a LONG, b LONG", (1, 2), (2, 1), (3, 2), (5, 6), (7, 7), (None, 3), *[(100 + i, 101 + i) for i in range(60)], *[(200, 300 + i) for i in range(30)])
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 7, **{100 + i: 100 for i in range(61)}, 200: 200, **{300 + i: 200 for i in range(30)}}


def test_any_other_column_names(rows):
    names = "_id STRING, _row INT, _text STRING, _of INT, _value INT, fp INT, _fp INT"
    frame = rows(f"doc_id BIGINT, text STRING, {names}", *[(i, t, "a", 1, "b", 2, 3, 4, 5) for i, t in ((1, "one two three four"), (1, "one two three four"), (2, "one two three four"), (3, "other words are here"), (None, ""))])
    kept = keep_first_of_groups(frame)
    assert kept.columns == frame.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "None"]
