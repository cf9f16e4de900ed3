"""Benchmark passages: exact ones, reworded ones, clean texts, and the parts of the method."""

from __future__ import annotations

import random

import pytest
from ledgerlake.llm import decontam
from ledgerlake.llm.decontam import Checker, Finder, Item, clean_documents, common_subsequence, contaminated, latent_space, word_masks, words_of

FOLDER = "/root/testdata/sf0.01"


def plain(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_subsequence():
    rng = random.Random(5)
    for _ in range(200):
        a, b = [rng.choice("abcd") for _ in range(rng.randint(0, 70))], [rng.choice("abcde") for _ in range(rng.randint(0, 90))]
        assert common_subsequence(word_masks(a), b) == plain(a, b)


def test_answer_check():
    words = "one two three four five six seven eight nine ten".split()
    checker = Checker(Item(1, words, ["nine", "ten"]))
    assert checker.check(words, 0, 10) == (1.0, True)
    assert checker.check(words[:7], 0, 7) == (0.7, False)
    assert checker.check(["zero"] * 40, 0, 32) == (0.0, False)


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/benchmark.parquet")


@pytest.fixture(scope="module")
def truth(tables):
    """Pairs whose words stand in the document one after another."""
    documents, benchmark = (t.collect() for t in tables)
    texts = {r["doc_id"]: f" {' '.join(words_of(r['text']))} " for r in documents}
    return {(i, r["item_id"]) for r in benchmark for i, t in texts.items() if f" {' '.join(words_of(r['text']))} " in t}


def test_finds_all_and_nothing_else(tables, truth):
    documents, benchmark = tables
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(documents, benchmark).collect()}
    assert truth and got == truth
    bad = {i for i, _ in truth}
    kept = clean_documents(documents, benchmark)
    assert kept.columns == documents.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in documents.collect()} - bad


def test_recall_of_reworded_passages(tables, truth):
    documents, benchmark = tables
    items = decontam._blocks(benchmark, "text", "item_id", None)[0]
    finder = Finder(latent_space(items, documents.select("text")))
    rng, bad = random.Random(7), {i for i, _ in truth}
    hosts = [words_of(r["text"]) for r in documents.collect() if r["doc_id"] not in bad and r["n_chars"] > 600]
    vocabulary = sorted({w for h in hosts for w in h})
    for share, least in ((0.0, 1.0), (0.05, 0.97), (0.1, 0.9)):
        texts = []
        for item in finder.space.items:
            words = [rng.choice(vocabulary) if rng.random() < share else w for w in item.words]
            host = rng.choice(hosts)
            at = rng.randint(0, len(host))
            texts.append(" ".join(host[:at] + words + host[at:]))
        found = finder.find(texts)
        assert sum(n in f for n, f in enumerate(found)) >= least * len(texts)
        assert sum(len(f) - (n in f) for n, f in enumerate(found)) == 0


def test_blocks_of_items_and_odd_rows(rows, tables, monkeypatch):
    benchmark = tables[1]
    first, second = (r["text"] for r in benchmark.orderBy("item_id").limit(2).collect())
    documents = rows(
        "doc_id LONG, text STRING, item_id STRING, share INT",
        (1, "the and of", "x", 1), (None, None, "x", 1), (3, "", "x", 1), (None, first, "x", 1), (5, "x " * 1000 + second.upper() + " y" * 500, "x", 1), (5, "x " * 1000 + second.upper() + " y" * 500, "x", 1),
        (6, "long " * 60_000 + first, "x", 1),
    )
    want = [("5", 1), ("5", 1), ("6", 0), ("None", 0)]
    for most in (2000, 15):
        monkeypatch.setattr(decontam, "BLOCK_ITEMS", most)
        assert sorted((str(r[0]), r[1]) for r in contaminated(documents.drop("item_id"), benchmark).collect()) == want
    odd = benchmark.unionByName(rows("item_id LONG, text STRING", (None, None), (900, ""), (901, "..."), (1, second)))
    assert sorted({(str(r[0]), r[1]) for r in contaminated(documents.drop("item_id"), odd).collect()}) == sorted(set(want))
    kept = clean_documents(documents, benchmark)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "None"]
    assert clean_documents(documents, benchmark.limit(0)).count() == 7
    assert contaminated(documents.limit(0), benchmark).count() == 0 and contaminated(documents, benchmark.limit(0)).count() == 0


def test_exact_passages_of_a_full_block(rows, tables):
    """2,000 items of 10 words in one block: each is found between words of other items."""
    rng = random.Random(3)
    words = [f"w{n}" for n in range(3000)]
    items = [[rng.choice(words) for _ in range(10)] for _ in range(2000)]
    benchmark = rows("item_id LONG, text STRING, answer STRING", *((n, " ".join(w), None) for n, w in enumerate(items)))
    space = latent_space(benchmark, tables[0].select("text").limit(50))
    at = {tuple(i.words): n for n, i in enumerate(space.items)}
    texts = [" ".join([rng.choice(words) for _ in range(41)] + w + [rng.choice(words) for _ in range(43)]) for w in items[:300]]
    found = Finder(space).find(texts)
    assert all(f.get(at[tuple(w)], (0,))[0] == 1.0 for f, w in zip(found, items))
    assert len(space.parts) > 1 and sum(len(p.passages) for p in space.parts) == 2000


def test_runs_of_short_items(rows, tables):
    items = [["alpha"], ["beta", "gamma"], ["delta", "delta", "delta", "delta"], ["beta", "gamma", "alpha"]]
    space = latent_space(rows("item_id LONG, text STRING, answer STRING", *((n, " ".join(w), None) for n, w in enumerate(items))), tables[0].select("text").limit(50))
    at = {tuple(i.words): n for n, i in enumerate(space.items)}
    found = Finder(space).find(["x " * 40 + " ".join(w) + " x" * 40 for w in items] + [""])
    assert all(f[at[tuple(w)]][0] == 1.0 for f, w in zip(found, items)) and found[-1] == {}


def test_reworded_items_need_no_last_sentence():
    words = [f"w{n}" for n in range(20)]
    changed = [w if n % 10 < 7 else "other" for n, w in enumerate(words)]  # the last sentence, too
    found = []
    for item in (Item(1, words, words[17:]), Item(1, words, words[17:], told=True), Item(1, words[:10], words[7:10])):
        checker = Checker(item)
        share, answered = checker.check(changed, 0, 20)
        assert share == 0.7 and not answered
        found.append(checker.accepts(share, answered))
    assert found == [True, False, False]


def test_many_changed_words(tables):
    """Nearly all items are found with 20 % of the words replaced, most with 30 %."""
    documents, benchmark = tables
    finder = Finder(latent_space(decontam._blocks(benchmark, "text", "item_id", None)[0], documents.select("text")))
    rng = random.Random(11)
    for share, least in ((0.2, 0.95), (0.3, 0.8)):
        texts = [" ".join(["x"] * 45 + [f"new{n}" if rng.random() < share else w for n, w in enumerate(i.words)] + ["x"] * 45) for i in finder.space.items]
        found = finder.find(texts)
        assert sum(n in f for n, f in enumerate(found)) >= least * len(texts)
        assert sum(len(f) - (n in f) for n, f in enumerate(found)) == 0


def test_repeated_items_are_one(rows, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 10)
    text = "one two three four five six seven eight nine ten eleven twelve"
    benchmark = rows("item_id LONG, text STRING", *[(1, text)] * 40, (2, text), (3, "other words"))
    items, count = decontam._blocks(benchmark, "text", "item_id", None)
    assert count == 1 and items.count() == 3
    got = contaminated(rows("doc_id LONG, text STRING", (7, text)), benchmark).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(7, 1), (7, 2)]
