from __future__ import annotations

import pytest
from conftest import cells, day

from ledgerlake import schemas
from ledgerlake.operators import ledger, runs
from ledgerlake.operators.runs import Operation

TABLES = ("run_a", "run_b", "run_c")


@pytest.fixture
def ledgers(spark):
    for name in TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    yield spark.createDataFrame([], schemas.OPERATIONS), spark.createDataFrame([], schemas.EXECUTIONS)
    for name in TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def scripts(rows, **content):
    return rows("path string, content string", *[(f"sql/{n}.sql", c) for n, c in content.items()])


def states(outcome):
    return [(r.filepath, r.status, r.skip_reason) for r in outcome.executions.orderBy("id").collect()]


def test_build_twice(spark, rows, ledgers):
    build = Operation("build:1", "prod", "me", day(1))
    first = {"a": "CREATE TABLE run_a (x INT) USING parquet; INSERT INTO run_a VALUES (1);", "b": "CREATE TABLE run_b AS SELECT x FROM run_a -- end"}
    outcome = runs.build(scripts(rows, **first), build, *ledgers)
    assert (outcome.status, outcome.files_run) == ("success", 2) and spark.table("run_b").count() == 1
    ops, execs = runs.ledger_after(*ledgers, outcome)

    second = first | {"b": "INSERT INTO run_b VALUES (2)", "c": "CREATE TABLE run_c (x INT) USING parquet"}
    assert cells(runs.preview(scripts(rows, **second), ops, execs, "prod"), "filepath", "reason") == [
        ("sql/a.sql", None), ("sql/b.sql", "changed"), ("sql/c.sql", "new"),
    ]
    again = runs.build(scripts(rows, **second), build, ops, execs)
    assert states(again) == [("sql/a.sql", "skipped", "unchanged"), ("sql/b.sql", "success", ""), ("sql/c.sql", "success", "")]
    assert again.operations.first().id == 2 and spark.table("run_b").count() == 2


def test_failure_skips_the_rest(spark, rows, ledgers):
    build = Operation("build:1", "prod", "me", day(1))
    broken = scripts(rows, a="CREATE TABLE run_a (x INT) USING parquet", b="SELECT nothing FROM nowhere", c="CREATE TABLE run_c (x INT) USING parquet")
    outcome = runs.build(broken, build, *ledgers)
    assert states(outcome)[1:] == [("sql/b.sql", "failed", ""), ("sql/c.sql", "skipped", "Skipped due to failure in sql/b.sql")]
    record = outcome.operations.first()
    assert (outcome.status, record.status) == ("partial", "failed") and "nowhere" in record.error_message
    assert not spark.catalog.tableExists("run_c")

    spark.sql("DROP TABLE run_a")
    go_on = runs.build(broken, build, *ledgers, abort_on_error=False)
    assert [s for _, s, _ in states(go_on)] == ["success", "failed", "success"] and spark.catalog.tableExists("run_c")


def test_apply_and_revert(spark, rows, ledgers):
    change = Operation("2024-01-01-a", "prod", "me", day(1), "change")
    revert = Operation("2024-01-01-a", "prod", "me", day(2), "change", "revert")
    forward, backward = scripts(rows, a="CREATE TABLE run_a (x INT) USING parquet"), scripts(rows, a="DROP TABLE run_a")
    assert runs.apply_change(backward, revert, *ledgers) == "not applied"
    ledgers = runs.ledger_after(*ledgers, runs.apply_change(forward, change, *ledgers))
    assert spark.catalog.tableExists("run_a") and runs.apply_change(forward, change, *ledgers) == "already applied"
    ledgers = runs.ledger_after(*ledgers, runs.apply_change(backward, revert, *ledgers))
    assert not spark.catalog.tableExists("run_a")
    assert cells(ledger.latest_statuses(ledgers[0], "prod"), "status", "reverted_at") == [("reverted", day(2))]
    assert runs.apply_change(backward, revert, *ledgers) == "already reverted"
    assert runs.apply_change(forward, change, *ledgers).status == "success"


def test_nothing_to_run(rows, ledgers):
    outcome = runs.build(scripts(rows), Operation("b", "prod", "me", day(1)), *ledgers)
    assert (outcome.status, outcome.files_run, outcome.executions.count()) == ("success", 0, 0)
