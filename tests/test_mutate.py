from __future__ import annotations

import json

import pytest
from conftest import cells, day
from pyspark.sql import functions as F

from ledgerlake.operators import constraints, mutate
from ledgerlake.operators.mutate import Reference

NOW = day(20)


def now():
    return F.lit(NOW)


def test_insert_positions_and_defaults(todo, rows):
    incoming = rows("id bigint, user_id bigint, title string", (20, 1, "x"), (21, 1, "y"), (22, 3, "z"), (23, 9, "q"))
    placed = mutate.with_positions(todo["lists"], incoming, "user_id", ["id"])
    after = mutate.insert(todo["lists"], placed, {"color": F.lit("#000000"), "updated_at": now()})
    assert after.columns == todo["lists"].columns and after.count() == 7
    assert cells(after.where("id >= 20"), "id", "position", "color", "updated_at", "deleted_at") == [
        (20, 2, "#000000", NOW, None), (21, 3, "#000000", NOW, None), (22, 0, "#000000", NOW, None), (23, 0, "#000000", NOW, None),
    ]


def test_patch(todo, rows):
    patches = rows(
        "id bigint, seq int, title string, color string",
        (10, 1, "first", None), (10, 2, None, "#111111"), (10, 3, "third", None), (12, 1, "dead", None), (99, 1, "none", None),
    )
    after = mutate.patch(todo["lists"], patches, "id", ["title", "color"], now(), seq="seq")
    assert cells(after, "id", "title", "color", "updated_at") == [
        (10, "third", "#111111", NOW), (11, "work", None, day(1)), (12, "gone", None, day(1)),
    ]
    assert after.columns == todo["lists"].columns


def test_soft_delete(todo, rows):
    after = mutate.soft_delete(todo["lists"], rows("id bigint", (10,), (10,), (12,)), "id", now())
    assert cells(after, "id", "deleted_at", "updated_at") == [(10, NOW, NOW), (11, None, day(1)), (12, day(5), day(1))]


def test_toggle(todo, rows):
    keys = rows("id bigint", (100,), (101,), (102,), (103,), (103,))
    after = mutate.toggle(todo["items"], keys, "id", now())
    assert cells(after, "id", "is_completed", "completed_at", "updated_at") == [
        (100, True, NOW, NOW), (101, False, None, NOW), (102, False, None, day(1)), (103, False, None, NOW),
    ]


def test_delete_returning(todo):
    kept, removed = mutate.delete_where(todo["lists"], F.col("color") == "#FF0000")
    assert cells(kept, "id") == [(11,), (12,)] and cells(removed, "id") == [(10,)]


TODO_KEYS = {"users": "id", "lists": "id", "items": "id"}
TODO_REFERENCES = [Reference("items", "list_id", "lists"), Reference("lists", "user_id", "users")]


def test_cascade_over_a_chain(todo, rows):
    kept = mutate.cascade_delete(todo, TODO_KEYS, TODO_REFERENCES, "users", rows("id bigint", (3,)))
    assert {n: len(cells(d)) for n, d in kept.items()} == {"users": 2, "lists": 2, "items": 3}
    kept = mutate.cascade_delete(todo, TODO_KEYS, TODO_REFERENCES, "lists", rows("id bigint", (10,)))
    assert {n: len(cells(d)) for n, d in kept.items()} == {"users": 3, "lists": 2, "items": 1}


def test_cascade_over_self_reference_and_circle(rows):
    people = rows("id int, boss int, dept int", (1, None, 1), (2, 1, 1), (3, 2, 2), (4, None, 3), (5, None, None))
    departments = rows("id int, lead int", (1, 1), (2, 3), (3, 3), (4, None))
    keys = {"people": "id", "departments": "id"}
    own = [Reference("people", "boss", "people")]
    kept = mutate.cascade_delete({"people": people}, {"people": "id"}, own, "people", rows("id int", (2,)))
    assert cells(kept["people"], "id") == [(1,), (4,), (5,)]
    circle = [*own, Reference("people", "dept", "departments"), Reference("departments", "lead", "people")]
    kept = mutate.cascade_delete({"people": people, "departments": departments}, keys, circle, "people", rows("id int", (2,)))
    assert cells(kept["people"], "id") == [(1,), (5,)] and cells(kept["departments"], "id") == [(1,), (4,)]


def test_upsert_first_wins(rows):
    ddl = "identity_hash string, name string, registered_at timestamp, last_seen_at timestamp"
    table = rows(ddl, ("a", "Ann", day(1), day(1)), ("b", "Bob", day(1), day(1)))
    incoming = rows("identity_hash string, name string, seq int", ("a", "X", 1), ("c", "Second", 2), ("c", "First", 1))
    assert cells(mutate.upsert_first_wins(table, incoming, "identity_hash", "seq", now())) == [
        ("a", "Ann", day(1), NOW), ("b", "Bob", day(1), day(1)), ("c", "First", NOW, NOW),
    ]


def test_audit(rows):
    old = rows("id int, v string", (1, "a"), (2, None), (3, "c"))
    new = rows("id int, v string", (1, "a"), (2, "b"), (4, None))
    got = {r.row_id: r for r in mutate.audit(old, new, "id", "t", now()).collect()}
    assert {k: r.operation for k, r in got.items()} == {"2": "UPDATE", "3": "DELETE", "4": "INSERT"}
    assert json.loads(got["2"].old_data) == {"id": 2, "v": None} and json.loads(got["2"].new_data) == {"id": 2, "v": "b"}
    assert got["3"].new_data is None and got["4"].old_data is None and got["4"].changed_at == NOW


def test_snapshot_replaces_lineage(todo):
    written = mutate.snapshot(todo["lists"], "lists")
    assert cells(written) == cells(todo["lists"])
    assert "parquet" in written._jdf.queryExecution().toString().lower()


def test_keys(rows):
    df = rows("a int, b int", (1, 1), (1, 1), (1, None), (1, None), (2, 1))
    assert cells(constraints.unique_violations(df, ["a", "b"])) == [(1, 1, 2)]
    assert cells(constraints.unique_violations(df, ["a", "b"], nulls_distinct=False)) == [(1, None, 2), (1, 1, 2)]
    assert cells(constraints.primary_key_violations(df.dropDuplicates(), ["a", "b"])) == [(1, None, 1)]


def test_references(rows):
    child = rows("x int, y int", (1, 1), (1, 2), (1, 2), (None, 9), (9, None), (3, 3))
    parent = rows("a int, b int", (1, 1), (3, 3), (3, 3))
    assert cells(constraints.reference_violations(child, ["x", "y"], parent, ["a", "b"])) == [(1, 2, 2)]


@pytest.mark.parametrize("value, rules", [(None, ["v is not null"]), (1, []), (5, ["small"])])
def test_checks(rows, value, rules):
    df = rows("v int", (value,))
    broken = constraints.check_violations(df, ["v"], {"small": F.col("v") < 3})
    assert [r.rule for r in broken.collect()] == rules
