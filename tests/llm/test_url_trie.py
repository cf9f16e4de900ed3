"""URL rules against a plain reading of all of them, and against SQL."""

from __future__ import annotations

import random

from ledgerlake.llm import url_trie
from ledgerlake.llm.queries import QUERIES, SQL
from ledgerlake.llm.url_trie import ALLOW, BLOCK, RULES, UrlTrie, judge_urls, split_url
from oracle import _normal, connect

FOLDER = "/root/testdata/sf0.001"


def plain(host, path, rules):
    best = None
    for verdict, rule in rules:
        rule_host, _, rule_path = rule.partition("/")
        if host and (host == rule_host or host.endswith("." + rule_host)) and path.startswith("/" + rule_path):
            key = (len(rule), len(rule_host), verdict == BLOCK)
            if best is None or key > best[0]:
                best = (key, verdict, rule)
    return best[1:] if best else None


def test_split():
    assert split_url(None) == ("", "") and split_url("a.com/x") == ("", "")
    assert split_url("HTTP://A.Example.COM/En/?q=/x#f") == ("a.example.com", "/En/")
    assert split_url("x://h?p://i/") == ("h", "") and split_url("x://h#p") == ("h", "") and split_url("://") == ("", "")


def test_trie_equals_plain_reading():
    rng = random.Random(4)
    labels, segments = ["a", "b", "com", "net", "www"], ["en", "es", "e", ""]
    for _ in range(60):
        rules = [(rng.choice([ALLOW, BLOCK]), ".".join(rng.choices(labels, k=rng.randint(1, 3))) + "/" + "/".join(rng.choices(segments, k=rng.randint(0, 3)))) for _ in range(rng.randint(0, 12))]
        trie = UrlTrie(rules)
        for _ in range(200):
            host, path = ".".join(rng.choices(labels, k=rng.randint(0, 4))), rng.choice(["", "/"]) + "/".join(rng.choices(segments, k=rng.randint(0, 4)))
            assert trie.match(host, path) == plain(host, path, rules), (rules, host, path)


def test_rows(rows):
    frame = rows(
        "page_id INT, url STRING, host INT, rule STRING",
        (1, "http://www.example.com/en/1", 5, "old"), (2, "http://m.example.com/en/1", 5, "old"), (3, None, None, None), (3, "", None, None), (4, "x://example.net/es/", 0, ""), (4, "x://example.net/es/", 0, ""),
        (5, "x://example.com", 0, ""), (6, "x://notexample.com/en/", 0, ""),
    )
    got = sorted(((r["page_id"], r["rule"], r["verdict"]) for r in judge_urls(frame).collect()), key=str)
    assert got == [
        (1, "www.example.com/en/", "allow"), (2, "example.com/en/", "block"), (3, None, "allow"), (3, None, "allow"), (4, "net/es/", "block"), (4, "net/es/", "block"),
        (5, None, "allow"), (6, "com/", "allow"),
    ]
    assert judge_urls(frame, default=BLOCK, rules=()).where("verdict = 'block'").count() == 8
    assert judge_urls(frame.limit(0), rules=RULES).count() == 0


def test_lists_of_several_tries(rows, monkeypatch):
    """Any size of trie gives the same verdicts, repeated and contrary entries included."""
    rng = random.Random(9)
    labels, segments = ["a", "b", "com"], ["en", "es", "e"]
    rules = [(rng.choice([ALLOW, BLOCK]), ".".join(rng.choices(labels, k=rng.randint(1, 3))) + "/" + "/".join(rng.choices(segments, k=rng.randint(0, 2)))) for _ in range(30)]
    urls = ["x://" + ".".join(rng.choices(labels, k=3)) + "/" + "/".join(rng.choices(segments, k=3)) for _ in range(80)] + [None, "x"]
    frame = rows("url STRING, _judged INT, _longer STRING", *[(u, 7, "kept") for u in urls])
    for most in (7, 1000):
        monkeypatch.setattr(url_trie, "MOST_RULES", most)
        made = judge_urls(frame, rules=rules)
        assert made.columns == ["url", "_judged", "_longer", "host", "path", "rule", "verdict"]
        for r in made.collect():
            want = plain(*split_url(r["url"]), rules)
            assert (r["verdict"], r["rule"]) == (want or (ALLOW, None)) and (r["_judged"], r["_longer"]) == (7, "kept")


def test_many_rules_that_end_at_one_node():
    trie = UrlTrie([(BLOCK, f"a.com/p{i}") for i in range(20_000)])
    assert trie.match("a.com", "/p19999x") == (BLOCK, "a.com/p19999") and trie.match("a.com", "/q") is None
    assert len(trie.root["com"]["a"][None][None]) == 5  # looked up by length: 2 to 6 letters


def test_query_equals_sql(spark):
    frame = QUERIES["op9_url_filter"](spark, FOLDER)
    result = connect(FOLDER).execute(SQL["op9_url_filter"])
    assert _normal(frame.columns, [tuple(r) for r in frame.collect()]) == _normal([d[0] for d in result.description], result.fetchall())
