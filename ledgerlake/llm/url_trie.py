"""URL filter: a trie over reversed host labels and path segments, shipped to every task; the longest fitting rule decides."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import fresh, materialize, ship_package

ALLOW, BLOCK = "allow", "block"

#: The rules of the registered query.
RULES = (
    (ALLOW, "com/"),
    (BLOCK, "example.com/en/"),
    (ALLOW, "www.example.com/en/"),
    (BLOCK, "net/es/"),
    (BLOCK, "net/fr/"),
)

#: Most rules of one trie: about 300 bytes each, so the broadcast stays under 600 MB. Larger lists take several tries, one pass each.
MOST_RULES = 2_000_000

_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path. Null or without ``://``: both empty."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    path_end = min((i for i in (rest.find(c, end) for c in "?#") if i >= 0), default=len(rest))
    return rest[:end].translate(_LOWER), rest[end:path_end]


class UrlTrie:
    """Nodes are dicts from host label to node, last label first. The key ``None`` holds the root of the rule paths of that host."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root: dict = {}
        for verdict, rule in rules:
            if verdict not in (ALLOW, BLOCK):
                raise ValueError(f"verdict {verdict!r} of rule {rule!r}")
            host, _, path = rule.partition("/")
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})
            *whole, rest = path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            # what follows the last slash of a rule is a prefix of the next segment; looked up by its length
            ends = node.setdefault(None, {}).setdefault(len(rest), {})
            if ends.get(rest, (BLOCK,))[0] == BLOCK and rest in ends:
                continue  # the same entry both ways: block stays
            ends[rest] = (verdict, rule)

    def _paths(self, host: str) -> Iterator[tuple[int, dict]]:
        """Path roots of the host and its parents, with the length of that part of the host."""
        node, length = self.root, -1
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                return
            length += len(label) + 1
            if None in node:
                yield length, node[None]

    def best(self, host: str, path: str) -> tuple[int, int, bool, str] | None:
        """Length, host's length, whether it blocks, and text of the longest rule that fits; of equally long ones that with the longer host."""
        if not host or not path.startswith("/"):
            return None
        found = None
        for length, node in self._paths(host):
            at = 1
            while True:
                for size, ends in node.get(None, {}).items():
                    hit = ends.get(path[at : at + size])
                    if hit and (found is None or (len(hit[1]), length) > found[:2]):
                        found = (len(hit[1]), length, hit[0] == BLOCK, hit[1])
                end = path.find("/", at)
                node = node.get(path[at:end]) if end >= 0 else None
                if node is None:
                    break
                at = end + 1
        return found

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """Verdict and text of the rule of :meth:`best`."""
        hit = self.best(host, path)
        return (BLOCK if hit[2] else ALLOW, hit[3]) if hit else None


def judge_urls(df: DataFrame, url: str = "url", rules: Iterable[tuple[str, str]] = RULES, default: str = ALLOW) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (null if none fits) and ``verdict`` (of the rule, else ``default``).

    No shuffle. Null, empty and malformed urls have an empty host and path and get the default. Columns of these four
    names are replaced; all other columns, whatever their names, and repeated rows stay. An empty table gives an empty result. Lists of more
    than ``MOST_RULES`` are searched trie by trie; the longest rule of all tries counts, and of the same entry both ways the block.
    """
    ship_package(df.sparkSession)
    rules = list(rules)
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    name = fresh(df, "_judged")
    made = F.col(f"`{name}`")
    for start in range(0, max(1, len(rules)), MOST_RULES):
        judged = _judge(df, rules[start : start + MOST_RULES])(F.col(f"`{url}`"))
        if start:  # one trie at a time is held by a worker
            longer = fresh(df, "_longer")
            df = materialize(df, "judged").withColumn(longer, judged)
            other = F.col(f"`{longer}`")
            df = df.withColumn(name, F.when(F.coalesce(other["hit"] > made["hit"], other["hit"].isNotNull()), other).otherwise(made)).drop(longer)
        else:
            df = df.withColumn(name, judged)
    verdict = F.when(made["hit"].isNull(), default).when(made["hit"]["blocks"], BLOCK).otherwise(ALLOW)
    return df.select(*kept, made["host"].alias("host"), made["path"].alias("path"), made["hit"]["rule"].alias("rule"), verdict.alias("verdict"))


def _judge(df: DataFrame, rules: list[tuple[str, str]]):
    """A function of urls: host, path, and the best rule of these as a struct that sorts by precedence."""
    trie = df.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf("host string, path string, hit struct<size: int, host: int, blocks: boolean, rule: string>")
    def judged(urls: pd.Series) -> pd.DataFrame:
        best, rows = trie.value.best, []
        for host, path in map(split_url, urls):
            hit = best(host, path)
            rows.append((host, path, dict(zip(("size", "host", "blocks", "rule"), hit)) if hit else None))
        return pd.DataFrame(rows, columns=["host", "path", "hit"])

    return judged
