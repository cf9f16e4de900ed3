"""Procedures as SQL scripts: variables, conditions, loops, handlers, writes."""

from __future__ import annotations

from datetime import datetime

import pytest
from conftest import cells
from pyspark.errors import PySparkException

from ledgerlake.functions import routines
from ledgerlake.sources import results

AT = datetime(2024, 2, 1)
DDL = "id BIGINT, user_id BIGINT, title STRING, color STRING, position INT, updated_at TIMESTAMP, deleted_at TIMESTAMP"


@pytest.fixture
def tables(spark, rows, tmp_path):
    rows("id BIGINT, deleted_at TIMESTAMP", (1, None), (2, None), (3, AT)).createOrReplaceTempView("users")
    lists = rows(DDL, (10, 1, "home", None, 0, AT, None), (11, 1, "work", "#FF0000", 4, AT, None), (12, 1, "gone", None, 9, AT, AT), (13, 3, "x", None, 0, AT, None))
    with routines.changed_table(lists, "todo_lists", "id", str(tmp_path / "lists")) as made:
        yield made


def _lists(spark, user=1):
    return [(r["id"], r["title"], r["color"], r["position"]) for r in routines.call(spark, "get_todo_lists_by_user", user=user).collect()]


def test_create_takes_the_next_position(spark, tables):
    made = routines.call(spark, "create_todo_list", tables, id=20, user=1, title="it's new", color=None, as_of=AT)
    assert cells(made) == [(20, 5)]
    assert cells(routines.call(spark, "create_todo_list", tables, id=21, user=2, title="first", color="#00FF00", as_of=AT)) == [(21, 0)]
    assert _lists(spark) == [(10, "home", None, 0), (11, "work", "#FF0000", 4), (20, "it's new", None, 5)]
    assert _lists(spark, 2) == [(21, "first", "#00FF00", 0)]


@pytest.mark.parametrize("arguments, message", [({"id": 20, "user": 3}, "no active user 3"), ({"id": 20, "user": 99}, "no active user 99"), ({"id": 12, "user": 1}, "there is a list 12")])
def test_an_error_is_part_of_the_result_and_nothing_is_written(spark, tables, arguments, message):
    before = cells(spark.table("todo_lists"))
    done = results.run_sql(spark, routines.script("create_todo_list", tables), arguments | {"title": "t", "color": None, "as_of": AT})
    assert not done.success and message in done.error_message and done.rows is None
    assert cells(spark.table("todo_lists")) == before
    with pytest.raises(PySparkException, match=message):
        routines.call(spark, "create_todo_list", tables, **arguments, title="t", color=None, as_of=AT)


def test_update_and_delete_are_changes(spark, tables):
    assert cells(routines.call(spark, "update_todo_list", tables, id=11, title=None, color="#0000FF", as_of=AT)) == [(True,)]
    assert cells(routines.call(spark, "update_todo_list", tables, id=11, title="job", color=None, as_of=AT)) == [(True,)]
    assert cells(routines.call(spark, "update_todo_list", tables, id=12, title="no", color=None, as_of=AT)) == [(False,)]
    assert cells(routines.call(spark, "delete_todo_list", tables, id=10, as_of=AT)) == [(True,)]
    assert cells(routines.call(spark, "delete_todo_list", tables, id=10, as_of=AT)) == [(False,)]
    assert _lists(spark) == [(11, "job", "#0000FF", 4)]
    assert spark.table("todo_lists").count() == 4 and spark.table(tables["todo_lists"]).count() == 7


def test_import_makes_all_or_none(spark, rows, tables):
    ddl = "id BIGINT, user_id BIGINT, title STRING, color STRING"
    rows(ddl, (30, 1, "a", None), (31, 1, "b", None), (32, 2, "c", None), (33, 3, "d", None)).createOrReplaceTempView("incoming")
    assert cells(routines.call(spark, "import_todo_lists", tables, as_of=AT)) == [("made", 3)]
    assert _lists(spark)[2:] == [(30, "a", None, 5), (31, "b", None, 6)] and _lists(spark, 2) == [(32, "c", None, 0)]
    rows(ddl, (40, 1, "a", None), (30, 1, "again", None)).createOrReplaceTempView("incoming")
    assert cells(routines.call(spark, "import_todo_lists", tables, as_of=AT)) == [("failed", 0)]
    assert spark.table("todo_lists").where("id = 40").count() == 0


def test_renumber_loops_over_a_query(spark, tables):
    assert cells(routines.call(spark, "renumber_lists", tables, user=1, as_of=AT)) == [(2,)]
    assert _lists(spark) == [(10, "home", None, 0), (11, "work", "#FF0000", 1)]
    assert cells(routines.call(spark, "renumber_lists", tables, user=2, as_of=AT)) == [(0,)]


def test_names_are_dropped_at_the_end(spark, rows, tmp_path):
    with routines.changed_table(rows(DDL, (1, 1, "a", None, 0, AT, None)), "todo_lists", "id", str(tmp_path / "other")) as made:
        assert spark.table("todo_lists").count() == 1
    assert not spark.catalog.tableExists(made["todo_lists"]) and not spark.catalog.tableExists("todo_lists")
