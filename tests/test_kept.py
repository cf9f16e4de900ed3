"""Kept orders: pages, seeks, files touched."""

from __future__ import annotations

import pytest
from conftest import cells
from pyspark.sql import functions as F

from ledgerlake.operators import ranking
from ledgerlake.operators.kept import keep_order, open_order


@pytest.fixture(scope="module", params=[False, True], ids=["up", "down"])
def order(request, spark, tmp_path_factory):
    rows = spark.range(1000).selectExpr("id", "CASE WHEN id % 10 > 0 THEN id DIV 50 END AS g", "concat('t', id) AS title")
    path = str(tmp_path_factory.mktemp("order") / "kept")
    kept = keep_order(rows, ["g", "id"], path, descending=request.param, file_rows=60)
    everything = [r["id"] for r in rows.orderBy(*[F.col(c).desc() if request.param else F.col(c).asc() for c in ("g", "id")]).collect()]
    return kept, everything


@pytest.mark.parametrize("offset, size", [(0, 25), (55, 10), (500, 25), (990, 25), (1000, 5), (5000, 5), (0, 1000)])
def test_pages(order, offset, size):
    kept, everything = order
    page = kept.page(offset, size)
    assert [r["id"] for r in page.collect()] == everything[offset : offset + size]
    if size <= 25:
        assert len(page.inputFiles()) <= 2


def test_paging_on_by_key(order, spark):
    kept, everything = order
    again = open_order(spark, kept.path)
    assert again.order == ["g", "id"] and again.rows == 1000 and again.schema == kept.schema
    by_id = {r["id"]: r for r in again.page(0, 1000).collect()}
    for place in (150, 151, 599, 880, 899):
        row = by_id[everything[place]]
        if row["g"] is not None:
            page = again.page_after((row["g"], row["id"]), 30)
            assert [r["id"] for r in page.collect()] == everything[place + 1 : place + 31]
            assert len(page.inputFiles()) <= 3
    assert again.page_after((10**6, 10**6), 5).count() == (0 if not kept.descending else 5)


def test_index(order):
    kept, everything = order
    files = kept.index().orderBy("start").collect()
    assert sum(f["rows"] for f in files) == 1000 and max(f["rows"] for f in files) <= 60
    for f in files:
        assert f["first_key"]["id"] == everything[f["start"]] and f["last_key"]["id"] == everything[f["start"] + f["rows"] - 1]


def test_empty_order(spark, tmp_path):
    kept = keep_order(spark.range(0), ["id"], str(tmp_path / "k"))
    assert kept.rows == 0 and kept.page(0, 5).count() == 0 and kept.page_after((1,), 5).count() == 0


def test_near_pages_are_a_bounded_top_n(rows, spark):
    data = spark.range(500).selectExpr("id", "id % 7 AS g")
    page = ranking.page(data, ["g", "id"], 20, 10)
    assert "TakeOrderedAndProject" in page._jdf.queryExecution().executedPlan().toString()
    assert cells(page, "id") == cells(data.orderBy("g", "id").offset(20).limit(10), "id")
    assert cells(ranking.page(data, ["g", "id"], 5, 3, descending=True), "id") == cells(data.orderBy(F.desc("g"), F.desc("id")).offset(5).limit(3), "id")
