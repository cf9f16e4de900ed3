"""Subtree ranges, descendants and running totals against direct computation."""

from __future__ import annotations

import random

import pytest
from conftest import cells
from pyspark.sql import functions as F

from ledgerlake.operators.hierarchy import descendants, subtree_ranges
from ledgerlake.operators.ranking import range_count, running_totals

DDL = "id INT, up INT"


def _ranges(links):
    """id → (root, depth, first, last) by a depth-first walk; None for rows in or below a circle."""
    known = {i for i, _ in links}
    children = {}
    for i, up in links:
        children.setdefault(up if up in known else None, []).append(i)
    out, number = {}, 0

    def walk(i, root, depth):
        nonlocal number
        first = number
        number += 1
        for child in sorted(children.get(i, [])):
            walk(child, root, depth + 1)
        out[i] = (root, depth, first, number - 1)

    for root in sorted(children.get(None, [])):
        walk(root, root, 0)
    return [(i, *out.get(i, (None,) * 4)) for i, _ in links]


def _below(links):
    up = dict(links)
    found = set()
    reached = {r[0] for r in _ranges(links) if r[1] is not None}
    for i in reached:
        at, distance = up[i], 1
        while at in up:
            found.add((at, i, distance))
            at, distance = up[at], distance + 1
    return found


FORESTS = {
    "one": [(1, None)],
    "chain": [(i, i - 1 if i else None) for i in range(37)],
    "star": [(i, 0 if i else None) for i in range(50)],
    "orphans": [(5, 99), (6, 5), (7, None), (8, 7), (9, 98)],
    "circles": [(1, 2), (2, 3), (3, 1), (4, 3), (5, 4), (6, 6), (7, None), (8, 7)],
    "only a circle": [(1, 2), (2, 1)],
    "random": [(i, random.Random(i).choice([None, *range(max(0, i - 9), i)])) for i in range(120)],
}


@pytest.mark.parametrize("name", FORESTS)
def test_ranges(spark, name):
    links = FORESTS[name]
    nodes = spark.createDataFrame(links, DDL).repartition(3)
    ranges = subtree_ranges(nodes, "id", "up")
    assert ranges.columns == ["id", "root", "depth", "first", "last"]
    assert sorted(tuple(r) for r in ranges.collect()) == sorted(_ranges(links))
    if name in ("chain", "circles", "random"):
        seeds = spark.createDataFrame([(i,) for i, _ in links if i % 3 == 0] + [(None,), (12345,), (3,), (3,)], "seed INT")
        wanted = {(a, i, d) for a, i, d in _below(links) if a % 3 == 0}
        assert {tuple(r) for r in descendants(ranges, "id", seeds).collect()} == wanted


def test_no_rows(rows):
    empty = rows(DDL, (1, None)).limit(0)
    ranges = subtree_ranges(empty, "id", "up")
    assert ranges.count() == 0 and descendants(ranges, "id", empty.select("id")).count() == 0


def test_a_parent_with_most_rows_is_summed_in_ranges(spark):
    """The hub's children lie in many ranges, and none of the written files holds a large part of them."""
    rows = spark.range(2000).selectExpr("id", "CASE WHEN id % 10 < 9 THEN 1 ELSE id END AS parent", "id % 7 AS value")
    got = {r["id"]: r["before"] for r in running_totals(rows, "value", ["id"], within=["parent"], ranges=16).collect()}
    total = 0
    for i in range(2000):
        if i % 10 < 9:
            assert got[i] == total
            total += i % 7
        else:
            assert got[i] == 0
    written = running_totals(rows, "value", ["id"], within=["parent"], ranges=16).inputFiles()
    assert len(written) >= 16


def test_running_totals_over_all_rows_and_null_groups(rows):
    data = rows("g INT, at INT, v INT", (1, 1, 5), (1, 2, None), (1, 3, 2), (None, 1, 7), (None, 2, 1))
    assert cells(running_totals(data, "v", ["at"], within=["g"]), "g", "at", "before") == [(None, 1, 0), (None, 2, 7), (1, 1, 0), (1, 2, 5), (1, 3, 5)]
    assert [r["before"] for r in running_totals(data, "v", ["g", "at"]).orderBy("g", "at").collect()] == [0, 7, 8, 13, 13]


@pytest.fixture
def no_broadcast(spark):
    """A join that is broadcast fails."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1b")
    yield
    spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_ranges_are_not_broadcast(spark, no_broadcast):
    links = FORESTS["random"]
    ranges = subtree_ranges(spark.createDataFrame(links, DDL).repartition(3), "id", "up")
    assert sorted(tuple(r) for r in ranges.collect()) == sorted(_ranges(links))


def test_descendants_are_not_broadcast(spark, no_broadcast):
    links = FORESTS["random"]
    ranges = spark.createDataFrame(_ranges(links), "id INT, root INT, depth BIGINT, first BIGINT, last BIGINT")
    seeds = spark.createDataFrame([(i,) for i, _ in links if i % 3 == 0], "seed INT")
    assert {tuple(r) for r in descendants(ranges, "id", seeds).collect()} == {p for p in _below(links) if p[0] % 3 == 0}


def test_a_join_has_no_more_ranges_than_what_it_reads_asks_for(spark):
    numbers = spark.range(10**6)
    assert range_count(numbers.join(numbers.withColumnRenamed("id", "other"), F.col("id") == F.col("other"))) == 4
