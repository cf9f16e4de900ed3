"""The laid-out ledger: results, plans without an exchange, pruned buckets."""

from __future__ import annotations

import re

import pytest
from conftest import cells

from ledgerlake.operators import ledger
from ledgerlake.plans import roles
from ledgerlake.plans.registry import Tables
from ledgerlake.sources.ledger_tables import lay_out, laid_out

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def parts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for tables that are large
    t = Tables(spark, FOLDER)
    yield roles.operations(t), roles.executions(t), roles.disk_files(t)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def _below_join(plan: str) -> list[str]:
    lines = plan.split("\n")
    at = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line)
    return lines[at + 1 :]


def test_no_exchange_below_grouping_and_join(parts, tmp_path):
    operations, executions, files = parts
    with laid_out(operations, executions, str(tmp_path / "ledger"), buckets=8) as laid:
        statuses, latest, decided = laid.latest_statuses("prod"), laid.latest_executions("prod"), laid.file_decisions(files, "prod")
    assert "Exchange" not in _plan(statuses)
    assert not any("Exchange" in line for line in _below_join(_plan(latest)))
    inner = _plan(decided).split("SortMergeJoin")[-1]  # executions and operations
    assert "Exchange" not in inner
    assert cells(statuses) == cells(ledger.latest_statuses(operations, "prod"))
    assert cells(latest) == cells(ledger.latest_executions(executions, operations, "prod"))
    assert cells(decided) == cells(ledger.file_decisions(files, executions, operations, "prod"))
    assert "Exchange" in _plan(ledger.latest_statuses(operations, "prod"))  # so the check above can fail


def test_one_name_reads_one_bucket(spark, parts, tmp_path):
    operations, executions, _ = parts
    name = operations.select("name").first()["name"]
    with laid_out(operations, executions, str(tmp_path / "ledger"), buckets=8) as laid:
        history = laid.history_of(name, "prod")
        # files of other buckets are left out either way; only a bucketed scan shows it in the plan
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", False)
        try:
            assert re.search(r"SelectedBucketsCount: 1 out of 8", _plan(laid.history_of(name, "prod")))
        finally:
            spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
        wanted = operations.where(f"name = '{name}' AND config_name = 'prod'").orderBy("id", ascending=False)
        assert [tuple(r) for r in history.collect()] == [tuple(r) for r in wanted.collect()]


def test_appended_records(spark, parts, tmp_path):
    operations, executions, _ = parts
    laid = lay_out(operations.where("id % 3 > 0"), executions.where("change_id % 3 > 0"), str(tmp_path / "ledger"), "appended_ledger", buckets=4)
    try:
        laid.append(operations.where("id % 3 = 0"), executions.where("change_id % 3 = 0"))
        assert cells(laid.latest_statuses("prod")) == cells(ledger.latest_statuses(operations, "prod"))
        plan = _plan(laid.latest_executions("prod"))
        assert not any("Exchange" in line for line in _below_join(plan))
        assert laid.operations.count() == operations.count()
    finally:
        for table in laid.tables.values():
            spark.sql(f"DROP TABLE {table}")
