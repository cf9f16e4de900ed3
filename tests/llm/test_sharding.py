"""Shards: what stays together, what is equal, and the levels of differencing."""

from __future__ import annotations

import random
import zlib

import pytest
from ledgerlake.llm import sharding
from ledgerlake.llm.sharding import difference, shard_documents, write_shards

FOLDER = "/root/testdata/sf0.001"


def test_difference_places_every_sum():
    rng = random.Random(1)
    sizes = [rng.randint(1, 5000) for _ in range(3000)]
    bins = [row[0] for row in difference([(s,) for s in sizes], 16)]
    sums = [sum(s for s, b in zip(sizes, bins) if b == k) for k in range(16)]
    assert max(sums) - min(sums) <= 2
    units = [[rng.randint(1, 900) for _ in range(8)] for _ in range(40)]
    placed = difference(units, 8)
    assert all(sorted(row) == list(range(8)) for row in placed)
    assert difference([], 4) == [] and sorted(difference([(5, 5)], 2)[0]) == [0, 1]
    # the textbook case: 8, 7, 6, 5, 4 leaves a difference of 2
    bins = [row[0] for row in difference([(s,) for s in (8, 7, 6, 5, 4)], 2)]
    assert abs(sum(s if b else -s for s, b in zip((8, 7, 6, 5, 4), bins))) == 2


@pytest.mark.parametrize("levels", [False, True])
def test_documents(spark, monkeypatch, levels):
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    if levels:
        monkeypatch.setattr(sharding, "BLOCK", 20)
        monkeypatch.setattr(sharding, "MOST_UNITS", 4)
    texts = {r["doc_id"]: r["text"] for r in frame.collect()}
    got = shard_documents(frame.repartition(4), 4).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    shard_of, sums, slots = {}, [0] * 4, [[], [], [], []]
    for r in got:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        assert shard_of.setdefault(texts[r["doc_id"]], r["shard"]) == r["shard"]
        sums[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert max(sums) - min(sums) <= (0.15 if levels else 0.01) * sum(sums)


def test_odd_rows(rows, tmp_path):
    frame = rows("doc_id LONG, text STRING, size STRING", (1, "a", "x"), (1, "a", "x"), (None, None, None), (2, "", "x"), (3, "é" * 5, "x"), (4, "long " * 100_000, "x"))
    got = shard_documents(frame, 4).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == [("1", 2), ("1", 2), ("2", 1), ("3", 11), ("4", 500_001), ("None", 1)]
    assert len({(r["shard"], r["slot"]) for r in got}) == 6
    assert shard_documents(frame.limit(0), 4).count() == 0
    write_shards(frame, str(tmp_path / "out"), 4)
    back = frame.sparkSession.read.parquet(str(tmp_path / "out"))
    assert back.count() == 6 and back.where("text = 'a'").select("shard").distinct().count() == 1
