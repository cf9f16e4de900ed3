from __future__ import annotations

import hashlib

import pytest
from conftest import cells, day
from pyspark.sql import functions as F

from ledgerlake import schemas
from ledgerlake.operators import ledger


def op(id, name, status, direction="change", kind="change", config="prod", checksum="h1", at=1, error=""):
    return (id, name, kind, direction, checksum, day(at), "me", config, "1.0", status, error, 5)


def ex(id, op_id, path, status, checksum="h1"):
    return (id, op_id, path, "sql", checksum, "1.0", status, "", "", 1)


@pytest.fixture
def operations(spark):
    return lambda *data: spark.createDataFrame(list(data), schemas.OPERATIONS)


@pytest.fixture
def executions(spark):
    return lambda *data: spark.createDataFrame(list(data), schemas.EXECUTIONS)


def test_latest_statuses(operations):
    ops = operations(
        op(1, "a", "failed", error="boom"),
        op(2, "a", "success", at=2),
        op(3, "a", "success", "revert", at=3),
        op(4, "a", "failed", "revert", at=4),
        op(5, "b", "failed", error="boom"),
        op(6, "b", "success", config="dev"),
        op(7, "c", "success", "revert"),
        op(8, "d", "success", kind="build"),
    )
    got = cells(ledger.latest_statuses(ops, "prod"), "name", "status", "applied_at", "reverted_at", "error_message")
    assert got == [("a", "success", day(2), day(3), None), ("b", "failed", day(1), None, "boom")]


def test_file_decisions(operations, executions, rows):
    ops = operations(op(1, "build", "success", kind="build"), op(2, "old", "stale", kind="build"), op(3, "x", "success", config="dev"))
    runs = executions(
        ex(1, 1, "same", "success"), ex(2, 1, "changed", "success", "old"), ex(3, 1, "failed", "failed"),
        ex(4, 2, "stale", "success"), ex(5, 1, "skipped", "success"), ex(6, 1, "skipped", "skipped"),
        ex(7, 1, "pending", "pending"), ex(8, 3, "other", "success"),
    )
    names = ["same", "changed", "failed", "stale", "skipped", "pending", "other", "none"]
    files = rows("filepath string, checksum string", *[(n, "h1") for n in names])

    def reasons(**options):
        decided = ledger.file_decisions(files, runs, ops, "prod", **options)
        return {r.filepath: (r.needs_run, r.reason or r.skip_reason, r.previous_checksum) for r in decided.collect()}

    got = reasons()
    assert got["same"] == (False, "unchanged", "h1")
    assert got["changed"] == (True, "changed", "old")
    assert got["failed"] == (True, "failed", "h1")
    assert got["stale"] == (True, "stale", "h1")
    assert got["pending"] == got["other"] == got["none"] == (True, "new", None)
    assert got["skipped"] == (False, "unchanged", "h1")  # the run before the skip counts
    assert reasons(strict=True)["skipped"] == (True, "new", None)
    assert set(reasons(force=True).values()) == {(True, "force", None)}
    assert reasons(before=1)["same"] == (True, "new", None)


def test_change_decisions(operations, rows):
    ops = operations(
        op(1, "ok", "success"), op(2, "bad", "failed"), op(3, "undone", "reverted"), op(4, "torn", "stale"),
        op(5, "edited", "success", checksum="old"), op(6, "built", "success", kind="build"), op(7, "waiting", "pending", checksum="old"),
    )
    names = ["ok", "bad", "undone", "torn", "edited", "built", "unknown", "waiting"]
    changes = rows("name string, checksum string", *[(n, "h1") for n in names])
    got = {r.name: r.reason or r.skip_reason for r in ledger.change_decisions(changes, ops, "prod").collect()}
    assert got == {
        "ok": "already applied", "bad": "failed", "undone": "reverted", "torn": "stale", "edited": "changed", "built": "new",
        "unknown": "new", "waiting": "changed",
    }
    wide = {r.name: r.reason or r.skip_reason for r in ledger.change_decisions(changes, ops, "prod", any_type=True).collect()}
    assert (wide["ok"], wide["undone"], wide["built"]) == ("already-run", "stale", "already-run")
    forced = ledger.change_decisions(changes, ops, "prod", force=True)
    assert {(r.needs_run, r.reason, r.previous_status) for r in forced.collect()} == {(True, "force", None)}


def test_revert_eligibility(operations, rows):
    states = ["pending", "success", "failed", "reverted", "stale"]
    ops = operations(*[op(i, s, s) for i, s in enumerate(states)])
    names = rows("name string", *[(s,) for s in [*states, "unknown"]])
    got = {r.name: (r.can_revert, r.reason) for r in ledger.revert_eligibility(names, ops, "prod").collect()}
    assert got == {
        "pending": (False, "not applied yet"), "success": (True, None), "failed": (True, None),
        "reverted": (False, "already reverted"), "stale": (False, "schema was torn down"), "unknown": (False, "not applied"),
    }
    forced = {r.name: r.can_revert for r in ledger.revert_eligibility(names, ops, "prod", force=True).collect()}
    assert forced == {s: s != "unknown" for s in [*states, "unknown"]}


@pytest.fixture
def reconciled(operations, rows):
    ops = operations(
        op(1, "a", "success", at=1), op(2, "b", "success", at=3), op(3, "c", "success", at=2), op(4, "d", "reverted", at=4),
        op(5, "lost", "success", at=5), op(6, "e", "failed", at=6), op(7, "f", "success", at=3),
    )
    disk = rows("name string, path string", *[(n, f"/{n}") for n in ["a", "b", "c", "d", "e", "f", "new"]])
    return ledger.reconcile(disk, ledger.latest_statuses(ops, "prod"))


def test_reconcile(reconciled):
    got = {r.name: (r.status, r.is_new, r.orphaned, r.path) for r in reconciled.collect()}
    assert got["new"] == ("pending", True, False, "/new")
    assert got["lost"] == ("success", False, True, None)
    assert got["a"] == ("success", False, False, "/a")


def test_next_and_rewind(reconciled):
    names = lambda df: [r.name for r in df.collect()]
    assert names(ledger.next_changes(reconciled)) == ["d"]
    assert names(ledger.fast_forward(reconciled)) == ["d", "new"]
    assert names(ledger.rewind_set(reconciled, 2)) == ["b", "f"]
    assert names(ledger.rewind_set(reconciled, "f")) == ["b", "f"]
    assert names(ledger.rewind_set(reconciled, "b")) == ["b"]
    assert names(ledger.rewind_set(reconciled, "a")) == ["b", "f", "c", "a"]
    assert names(ledger.rewind_set(reconciled, "lost")) == []
    with pytest.raises(LookupError):
        ledger.require_target(reconciled, "lost")


def test_abort_and_rollup(rows):
    files = rows(
        "batch int, seq int, filepath string, status string",
        (1, 1, "a", "success"), (1, 2, "b", "failed"), (1, 3, "c", "pending"), (1, 4, "d", "failed"),
        (2, 1, "a", "failed"), (3, 1, "a", "success"), (3, 2, "b", "skipped"),
    )
    done = ledger.abort_cascade(files)
    got = {(r.batch, r.seq): (r.status, r.skip_reason) for r in done.collect()}
    assert got[(1, 3)] == got[(1, 4)] == ("skipped", "Skipped due to failure in b")
    assert got[(1, 2)] == ("failed", "") and got[(3, 2)] == ("skipped", "")
    assert cells(ledger.batch_rollup(done)) == [
        (1, 1, 2, 1, "partial", "failed"), (2, 0, 0, 1, "failed", "failed"), (3, 1, 1, 0, "success", "success"),
    ]


def test_combined_checksum(spark):
    """A group with a third of the rows under a null key, small groups, and hashes that are null."""
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("k"),
        F.lit(1).alias("j"),
        F.when((F.col("id") % 40 != 7) & (F.col("id") % 11 > 0), F.sha2(F.col("id").cast("string"), 256)).alias("checksum"),
    )
    members: dict[str | None, list[str]] = {}
    for row in df.collect():
        members.setdefault(row.k, []).extend([row.checksum] if row.checksum else [])
    want = {(k, 1, hashlib.sha256("".join(sorted(v)).encode()).hexdigest()) for k, v in members.items()}
    got = [tuple(r) for r in ledger.combined_checksum(df, ["k", "j"]).collect()]
    assert len(got) == len(want) and set(got) == want
    assert ledger.combined_checksum(df.limit(0), ["k", "j"]).count() == 0


def test_a_second_closing_or_patch_is_an_error(rows, operations):
    from ledgerlake.operators import mutate
    from pyspark.errors import PySparkException

    ops = operations(op(1, "a", "pending"))
    closings = rows("id bigint, status string, checksum string, duration_ms double, error_message string", (1, "success", "c", 1.0, "e" * 5000), (1, "failed", "c", 1.0, None))
    with pytest.raises(PySparkException, match="more than one row"):
        ledger.finalize(ops, closings).collect()
    assert ledger.finalize(ops, closings.limit(1)).first().error_message == "e" * 5000
    assert ledger.finalize(ops, closings.limit(1), error_limit=2000).first().error_message == "e" * 2000
    table = rows("id bigint, v string, deleted_at timestamp, updated_at timestamp", (1, "x", None, None))
    patches = rows("id bigint, v string, seq int", (1, "y", 1), (1, "z", 2))
    with pytest.raises(PySparkException, match="more than one row"):
        mutate.patch(table, patches, "id", ["v"], F.lit(None).cast("timestamp")).collect()
    assert mutate.patch(table, patches, "id", ["v"], F.lit(None).cast("timestamp"), seq="seq").first().v == "z"


def test_file_status_summary(rows):
    decisions = rows(
        "filepath string, needs_run boolean, reason string",
        ("a", False, None), ("b", True, "new"), ("c", True, "stale"), ("d", True, "changed"), ("e", True, "failed"), ("f", True, "force"),
    )
    assert cells(ledger.file_status_summary(decisions)) == [("changed", 1, 0), ("failed", 1, 0), ("new", 3, 0), ("previously-run", 1, 1)]


def test_history(operations, executions):
    ops = operations(op(1, "a", "success"), op(2, "b", "failed", kind="run", error="e"), op(3, "a", "success", "revert"), op(4, "a", "success", config="dev"))
    assert [r.id for r in ledger.history(ops, "prod").collect()] == [3, 1]
    assert [r.id for r in ledger.history(ops, "prod", types=()).collect()] == [3, 2, 1]
    assert [(r.id, r.error_message) for r in ledger.history(ops, "prod", types=("build", "run")).collect()] == [(2, "e")]
    assert [r.id for r in ledger.history(ops, "prod", name="a", limit=1).collect()] == [3]
    runs = executions(ex(2, 1, "b", "success"), ex(1, 1, "a", "failed"), ex(3, 2, "c", "success"))
    assert [(r.id, r.error_message) for r in ledger.files_of(runs, 1).collect()] == [(1, None), (2, None)]


def test_ledger_updates(operations, executions, rows):
    ops = operations(
        op(1, "a", "success"), op(2, "a", "failed"), op(3, "a", "success", "revert"), op(4, "b", "reverted"), op(5, "b", "pending", config="dev"),
    )
    status = lambda df: {r.id: r.status for r in df.collect()}
    assert status(ledger.mark_all_stale(ops, "prod")) == {1: "stale", 2: "stale", 3: "success", 4: "reverted", 5: "pending"}
    assert ledger.count_to_mark_stale(ops, "prod").first()[0] == 2
    marked = ledger.mark_reverted(ops, rows("name string", ("a",), ("a",), ("zzz",)), "prod")
    assert status(marked) == {1: "success", 2: "reverted", 3: "success", 4: "reverted", 5: "pending"}

    closings = rows(
        "id bigint, status string, checksum string, duration_ms double, error_message string",
        (1, "failed", None, 2.5, "x" * 3000), (99, "success", "h", 1.0, None),
    )
    closed = {r.id: r for r in ledger.finalize(ops, closings).collect()}
    assert len(closed) == 5 and (closed[1].status, closed[1].checksum, closed[1].duration_ms) == ("failed", "", 3)
    assert len(closed[1].error_message) == 3000 and closed[2].status == "failed" and closed[2].checksum == "h1"
    assert cells(ledger.unmatched_closings(ops, closings)) == [(99, "No operation record found with id 99")]

    runs = executions(ex(1, 1, "f", "success"), ex(2, 4, "f", "success"))
    kept_ops, kept_runs = ledger.purge(ops, runs, "a", "prod")
    assert cells(kept_ops, "id") == [(4,), (5,)] and cells(kept_runs, "id") == [(2,)]

    record = ledger.reset_record(ops, "prod", "me", "why", F.lit(day(9))).first()
    assert (record.id, record.name, record.status, record.error_message, record.executed_at) == (6, "__reset__", "success", "why", day(9))
    assert ledger.latest_version(ops).first().id == 5


def test_expired_leases(rows):
    leases = rows("config_name string, expires_at timestamp", ("a", day(1)), ("b", day(2)), ("c", day(3)))
    assert cells(ledger.expired_leases(leases, F.lit(day(2))), "config_name") == [("a",)]
