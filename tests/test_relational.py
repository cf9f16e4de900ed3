from __future__ import annotations

import pytest
from conftest import cells, day
from pyspark.sql import functions as F

from ledgerlake.operators import hierarchy, ranking, relational


def test_active_view_hides_columns(todo):
    view = relational.active_view(todo["users"])
    assert view.columns == ["id", "email", "username"]
    assert cells(view, "id") == [(1,), (2,)]


def test_lookup_skips_deleted(todo):
    assert cells(relational.lookup(todo["users"], "id", 3)) == []
    assert cells(relational.lookup(todo["users"], "email", "two@test.com"), "id") == [(2,)]


def test_counts_in_both_semantics(todo):
    columns = ("id", "total_items", "completed_items", "pending_items")
    plain = relational.lists_with_counts(todo["lists"], todo["items"])
    assert cells(plain, *columns) == [(10, 2, 1, 1), (11, 0, 0, 0)]
    padded = relational.lists_with_counts(todo["lists"], todo["items"], padded=True)
    assert cells(padded, *columns) == [(10, 2, 1, 1), (11, 1, 0, 0)]


def test_join_active_needs_both_sides(todo):
    joined = relational.join_active(todo["items"], todo["lists"], "list_id", "id", {"user_id": "user_id", "title": "list_title"})
    assert cells(joined, "id", "user_id", "list_title") == [(100, 1, "home"), (101, 1, "home")]


def test_semi_and_anti(todo):
    assert cells(relational.with_match(todo["users"], todo["lists"], "id", "user_id"), "id") == [(1,), (3,)]
    assert cells(relational.without_match(todo["users"], todo["lists"], "id", "user_id"), "id") == [(2,)]


def test_search(rows):
    df = rows("a string, b int, c struct<x:string>", ("Foo", 1, ("bar",)), (None, 42, None))
    assert cells(relational.search(df, "FOO"), "b") == [(1,)]
    assert cells(relational.search(df, "null"), "b") == [(42,)]
    assert cells(relational.search(df, "4", "b"), "b") == [(42,)]
    assert cells(relational.search(df, '"x":"bar"'), "b") == [(1,)]
    assert relational.search(df, "").count() == 2


def test_exclude_prefix_keeps_missing_names(rows):
    df = rows("n string", ("__ledger_x",), ("users",), (None,))
    assert cells(relational.exclude_prefix(df, "n", "__ledger_")) == [(None,), ("users",)]


def test_next_position(todo):
    assert cells(relational.next_position(todo["lists"], "user_id")) == [(1, 2)]


def test_table_counts_of_missing_table(todo):
    counts = relational.table_counts({"users": todo["users"], "nothing": None})
    assert cells(counts) == [("nothing", 0), ("users", 3)]


def test_ordered_array_and_text(rows):
    df = rows("k string, p int, v string", ("a", 2, "y"), ("a", 1, "x"), ("b", 1, "z"), ("a", 3, "x"))
    assert cells(relational.ordered_array(df, ["k"], "p", "v", "vs")) == [("a", ["x", "y", "x"]), ("b", ["z"])]
    assert cells(relational.joined_text(df, ["k"], "v", "|", "t")) == [("a", "x|y"), ("b", "z")]
    assert cells(relational.value_set(df, ["k"], "v", "s")) == [("a", ["x", "y"]), ("b", ["z"])]


def test_null_order(rows):
    df = rows("v int", (2,), (None,), (1,))
    assert [r.v for r in ranking.sort_by(df, "v").collect()] == [1, 2, None]
    assert [r.v for r in ranking.sort_by(df, "v", descending=True).collect()] == [None, 2, 1]


def test_row_numbers_equal_window(spark):
    """A third of all rows in one group, ties, nulls, and more ranges than rows in some groups."""
    from pyspark.sql.window import Window

    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"),
        F.when(F.col("id") % 7 != 0, F.col("id") % 11).alias("v"),
        "id",
    )
    for within in ([], ["k"]):
        for descending in (False, True):
            order = [F.col(c).desc() if descending else F.col(c).asc() for c in ("v", "id")]
            spec = (Window.partitionBy(*within) if within else Window).orderBy(*order)
            want = {r.id: r.rn for r in df.select("id", F.row_number().over(spec).alias("rn")).collect()}
            numbered = ranking.number_rows(df, ["v", "id"], within, descending, ranges=16)
            assert {r.id: r.row_num for r in numbered.collect()} == want


def test_row_numbers_split_the_hot_group(spark):
    """No range holds much more than its share, though one group holds everything; more data makes more ranges."""
    df = spark.range(10_000).select(F.lit(1).alias("k"), "id")
    placed = df.repartitionByRange(10, "k", "id").groupBy(F.spark_partition_id()).count()
    assert placed.count() == 10 and placed.agg(F.max("count")).first()[0] < 2500
    assert ranking.range_count(df) == 4 and 4 < ranking.range_count(spark.range(10**9)) < 100


@pytest.mark.parametrize("kind", ["double", "string", "timestamp", "timestamp_ntz", "decimal(20,4)", "date", "boolean", "binary"])
def test_row_numbers_of_any_type(spark, kind):
    from pyspark.sql.window import Window

    number = F.col("id") % 97
    value = {"double": number / 7, "timestamp": F.timestamp_micros(number * 1_000_001), "binary": F.encode(number.cast("string"), "utf-8")}
    value |= {"timestamp_ntz": F.timestamp_micros(number * 1_000_001), "date": F.date_add(F.lit("1969-12-01").cast("date"), number.cast("int"))}
    value |= {"boolean": number > 50}
    shown = F.when(F.col("id") % 5 > 0, value.get(kind, number)).cast(kind)
    df = spark.range(800).select(shown.alias("v"), "id")
    want = {r.id: r.rn for r in df.select("id", F.row_number().over(Window.orderBy("v", "id")).alias("rn")).collect()}
    assert {r.id: r.row_num for r in ranking.number_rows(df, ["v", "id"], ranges=9).collect()} == want


def test_row_numbers_of_nothing(spark):
    assert ranking.number_rows(spark.range(0), ["id"]).count() == 0


def test_pages(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("v"))
    for offset in (0, 40, 498, 600):
        for descending in (False, True):
            got = [r.id for r in ranking.page(df, ["v", "id"], offset, 5, descending).collect()]
            want = sorted(((i % 3, i) for i in range(500)), reverse=descending)[offset : offset + 5]
            assert got == [i for _, i in want]  # in order


def test_auto_sort(rows):
    assert ranking.auto_sort_column(rows("id int, updated_at timestamp, created_at timestamp", (1, day(1), day(1)))) == "created_at"
    assert ranking.auto_sort_column(rows("id int, created_at timestamp, updated_at timestamp", (1, None, day(1)))) == "updated_at"
    assert ranking.auto_sort_column(rows("id int, x string", (1, "2024-01-01"), (2, "2024-01-02"), (3, "2024-01-03"))) == "x"
    assert ranking.auto_sort_column(rows("user_id int, name string", (1, "a"))) == "user_id"
    assert ranking.auto_sort_column(rows("name string", ("a",))) is None
    assert ranking.auto_sort_column(rows("name string, x bigint", ("a", 1_700_000_000), ("b", 1_700_000_500))) == "x"
    late = [("a", None)] * 40 + [("b", day(1))]  # dates beyond any prefix of the rows
    assert ranking.auto_sort_column(rows("name string, x timestamp", *late)) == "x"
    assert [r.id for r in ranking.auto_sort(rows("id int", (1,), (3,), (2,))).collect()] == [3, 2, 1]


def test_hierarchy(rows):
    df = rows("id bigint, up bigint", (1, None), (2, 1), (3, 2), (4, 99), (5, 6), (6, 5), (7, 6))
    got = hierarchy.roots_and_depths(df, "id", "up")
    assert cells(got) == sorted([(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 4, 0), (5, None, None), (6, None, None), (7, None, None)])
    assert cells(hierarchy.mark_descendants(df, "id", "up", df.where("id in (2, 5)").select("id"))) == [(2,), (3,), (5,), (6,), (7,)]


def test_hierarchy_of_a_long_chain(spark):
    df = spark.range(700).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("up"))
    deepest = hierarchy.roots_and_depths(df, "id", "up").orderBy(F.col("depth").desc()).first()
    assert (deepest["id"], deepest["root"], deepest["depth"]) == (699, 0, 699)


def test_parent_join(rows):
    df = rows("id int, name string, boss int", (1, "a", None), (2, "b", 1))
    assert cells(relational.with_parent(df, "id", "boss", {"name": "boss_name"}), "id", "boss_name") == [(1, None), (2, "a")]
