from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from conftest import cells, day
from pyspark.sql import functions as F

from ledgerlake import schemas, session
from ledgerlake.operators import eventlog, metadata, teardown
from ledgerlake.sources import logs, results, seeds
from ledgerlake.sources.versions import VersionedTable
from ledgerlake.streaming import progress, tail


def entry(n=0, **fields):
    return json.dumps({"time": f"2024-01-01T00:00:{n:02d}.000Z", "level": "info", "type": "build:start", "message": f"m{n}"} | fields)


BROKEN = ["{bad", entry(message=5), entry(level=None), '{"time":"x"}', "[1]", "null", entry() + " tail", f"{entry()},{entry()}"]


def test_parse_drops_what_is_not_an_entry(rows):
    lines = rows("value string", *[(x,) for x in [entry(1, data={"b": 1, "a": [1, 2]}, context={}), "", *BROKEN]])
    assert cells(eventlog.parse_lines(lines), "message", "data", "context") == [("m1", '{"b":1,"a":[1,2]}', "{}")]


def test_tail(rows):
    lines = rows("value string", *[(entry(n),) for n in range(10)], ("{bad",), (" ",))
    newest = eventlog.tail(lines, 3)
    assert [(r.message, r.total_lines, r.has_more) for r in newest.collect()] == [("m9", 11, True), ("m8", 11, True), ("m7", 11, True)]
    assert not eventlog.tail(lines, 11).first().has_more


def test_log_round_trip(spark, tmp_path):
    path = str(tmp_path / "log")
    raw = spark.createDataFrame(
        [("t1", "file:after", '{"status":"success","filepath":"f","durationMs":1,"token":"abc"}'), ("t2", "x:start", "{}")], "time string, type string, data string"
    )
    entries = eventlog.redact(eventlog.format_entries(raw))
    logs.write_log(entries, path)
    read = logs.read_log(spark, path)
    assert cells(read, "time", "level", "message") == [("t1", "info", "Executed f (1ms)"), ("t2", "info", "x start")]
    assert "abc" not in str(read.collect())
    assert logs.read_log(spark, path, limit=1).first().time == "t2"


def test_retention_keeps_the_time_of_day(rows):
    df = rows("executed_at string", ("2024-02-29 11:59:59",), ("2024-02-29 12:00:00",)).select(F.col("executed_at").cast("timestamp"))
    as_of = F.lit("2024-03-31 12:00:00").cast("timestamp")
    assert eventlog.retained(df, as_of, 1).count() == eventlog.dropped(df, as_of, 1).count() == 1


RUN = [
    (1, 1, "build:start", None, None, 3), (1, 2, "file:before", None, "a", None), (1, 3, "file:after", "success", "a", None),
    (1, 4, "file:before", None, "b", None), (1, 5, "file:skip", None, "c", None), (2, 1, "build:start", None, None, 1),
    (2, 2, "file:before", None, "a", None), (2, 3, "file:after", "failed", "a", None), (2, 4, "build:complete", "failed", None, None),
    (3, 1, "file:dry-run", "success", "a", None), (3, 2, "file:dry-run", "failed", "b", None),
]
RUN_DDL = "run_id int, seq int, type string, status string, filepath string, file_count int"
PROGRESS = [
    (1, 1, 1, 0, 0, 3, "running", None, "b"), (2, 0, 0, 1, 0, 1, "complete", "failed", None), (3, 0, 0, 1, 1, None, "idle", None, None),
]


def test_progress(rows):
    assert cells(eventlog.run_progress(rows(RUN_DDL, *RUN))) == PROGRESS


def _timed(rows, minutes):
    return [(*r, datetime(2024, 1, 1) + timedelta(minutes=m)) for r, m in zip(rows, minutes)]


def _run_parts(spark, tmp_path, parts, **settings):
    """Each part arrives as a file and the stream is started anew for it."""
    folder, output, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    table = VersionedTable(spark, output)
    for part in parts:
        spark.createDataFrame(part, RUN_DDL + ", time timestamp").coalesce(1).write.mode("append").parquet(folder)
        log = spark.readStream.schema(RUN_DDL + ", time timestamp").parquet(folder)
        progress.start_progress(progress.progress_stream(log, silence_minutes=60), output, state, once=True, **settings).awaitTermination()
    return table


def test_progress_stream_over_several_batches(spark, tmp_path):
    events = _timed(RUN, range(len(RUN)))
    table = _run_parts(spark, tmp_path, (events[:4], events[4:7], events[7:8], events[8:]))
    assert cells(progress.current_progress(spark, table.path)) == PROGRESS
    # what a batch did not change is not written again: a row for each run and batch
    assert table.read().count() == sum(len({r[0] for r in part}) for part in (RUN[:4], RUN[4:7], RUN[7:8], RUN[8:]))


def test_finished_and_silent_runs_leave_the_state(spark, tmp_path):
    start = (1, 1, "build:start", None, None, 2)
    done = (1, 3, "build:complete", "success", None, None)
    parts = [
        _timed([start, (2, 1, "file:skip", None, "a", None)], [0, 1]),
        _timed([(1, 2, "file:after", "success", "a", None), done], [5, 6]),
        _timed([(3, 1, "file:skip", None, "a", None)], [500]),  # time goes on: 1 has finished, 2 is silent
        _timed([(2, 2, "file:after", "failed", "b", None), (3, 2, "file:skip", None, "b", None)], [501, 502]),  # 2 goes on after all
        _timed([(4, 1, "file:skip", None, "a", None)], [5000]),
    ]
    table = _run_parts(spark, tmp_path, parts)
    closed = cells(table.read().where("closed"), "run_id", "first", "changes", "files_run", "files_skipped", "files_failed", "phase")
    assert closed == [(1, 1, 3, 1, 0, 0, "complete"), (2, 1, 2, 0, 1, 0, None), (2, 2, 2, 0, 0, 1, None), (3, 1, 3, 0, 2, 0, None)]
    got = cells(progress.current_progress(spark, table.path), "run_id", "files_run", "files_skipped", "files_failed", "phase", "status")
    assert got == [(1, 1, 0, 0, "complete", "success"), (2, 0, 1, 1, "idle", None), (3, 0, 2, 0, "idle", None), (4, 0, 1, 0, "idle", None)]


def test_progress_is_compacted(spark, tmp_path):
    events = _timed(RUN, range(len(RUN)))
    table = _run_parts(spark, tmp_path, [events[i : i + 2] for i in range(0, len(events), 2)], most_folders=2)
    assert cells(progress.current_progress(spark, table.path)) == PROGRESS
    assert len(table.latest().folders) <= 2 and "compact" in {v.operation for v in table.versions()}


def test_live_tail(spark, tmp_path):
    folder, output, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    batches = ([entry(1, data={"password": "abc"}), "{bad"], [entry(2, type="file:before"), entry(3)])
    for lines in batches:
        spark.createDataFrame([(x,) for x in lines], "value string").write.mode("append").text(folder)
        stream = tail.tail_stream(spark, folder, level="info")
        tail.start_tail(stream, output, state, once=True).awaitTermination()
    got = cells(spark.read.parquet(output), "message", "data")
    assert got == [("m1", '{"password":"<Password *** (3) />"}'), ("m3", None)]


def test_csv_seed(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text('name, email ,age\n\n  Ann , a@x , \n\nBo,"b,\n ""c""",3\n')
    assert [tuple(r) for r in seeds.read_csv_seed(spark, str(path), multiline=True).collect()] == [("Ann", "a@x", ""), ("Bo", 'b,\n "c"', "3")]


def test_json5_seed(spark, tmp_path):
    path = tmp_path / "s.json5"
    path.write_text("""// head
[ { name: 'Ann', url: "http://x//y", tags: ['a', 'b',], }, /* ,] */
  { name: "Bo, ]", // note
    url: 'it\\'s', },
]""")
    got = [(r.name, r.url, r.tags) for r in seeds.read_json_seed(spark, str(path)).collect()]
    assert got == [("Ann", "http://x//y", ["a", "b"]), ("Bo, ]", "it's", None)]
    lines = tmp_path / "lines.json5"
    lines.write_text("// head\n{ a: 1, /* x */ 'b': 'x,}', }\n\n{ a: 2, b: null }\n")
    for schema in (None, "a BIGINT, b STRING"):
        assert cells(seeds.read_json_seed(spark, str(lines), schema, per_line=True), "a", "b") == [(1, "x,}"), (2, None)]
    one = tmp_path / "one.json"
    one.write_text('{"users": [{"a": 1}]}')
    assert seeds.read_json_seed(spark, str(one), "users ARRAY<STRUCT<a: INT>>").first().users[0].a == 1


def test_append_rows(spark, rows):
    spark.sql("DROP TABLE IF EXISTS seed_roles")
    spark.sql("CREATE TABLE seed_roles (name STRING, permissions STRING) USING parquet")
    try:
        seeds.append_rows(rows("name string, permissions array<string>, x int", ("admin", ["r", "w"], 1)), "seed_roles", ["name", "permissions"])
        assert cells(spark.table("seed_roles")) == [("admin", '["r","w"]')]
    finally:
        spark.sql("DROP TABLE seed_roles")


def test_results_and_history(spark, rows, tmp_path):
    history, folder = str(tmp_path / "history"), str(tmp_path / "results")
    rows("a int, b string", (1, None), (2, "x")).createOrReplaceTempView("numbers")
    done = results.record_sql(spark, "SELECT * FROM numbers WHERE a >= :least ORDER BY a", history, folder, {"least": 1})
    assert done.success and done.columns == ["a", "b"] and cells(done.rows) == [(1, None), (2, "x")]
    failed = results.record_sql(spark, "SELECT nothing FROM numbers", history, folder)
    assert not failed.success and "nothing" in failed.error_message
    at_run_time = results.record_sql(spark, "SELECT raise_error('late') FROM numbers", history, folder)
    assert not at_run_time.success and "late" in at_run_time.error_message
    entries = {r.query: r for r in results.recent(spark, history).collect()}
    nothing = results.record_sql(spark, "SELECT * FROM numbers WHERE false", str(tmp_path / "other"), folder)
    assert nothing.columns == ["a", "b"] and results.recent(spark, str(tmp_path / "other")).first().row_count == 0
    assert len(entries) == 3
    first = entries["SELECT * FROM numbers WHERE a >= :least ORDER BY a"]
    assert (first.row_count, first.success) == (2, True) and cells(spark.read.json(f"{first.results_path}/rows"), "a") == [(1,), (2,)]
    stats = results.history_stats(spark, history, folder).first()
    assert stats.entry_count == 3 and stats.results_size > 0
    assert len(VersionedTable(spark, history).latest().folders) == 3 and results.recent(spark, history, 2).count() == 2
    assert results.prune(spark, history, F.current_timestamp(), 1).count() == 0
    gone = results.prune(spark, history, F.current_timestamp() + F.expr("INTERVAL 40 DAYS"), 1)
    assert gone.count() == 3 and results.recent(spark, history).count() == 0
    assert results.prune(spark, str(tmp_path / "none"), F.current_timestamp(), 1).count() == 0
    late = results.run_sql(spark, "SELECT raise_error('late') FROM numbers")
    assert not late.success and "late" in late.error_message and late.duration_ms > 0
    assert results.run_sql(spark, "SELECT * FROM numbers").row_count == 2
    empty = results.run_sql(spark, "SELECT * FROM numbers WHERE false")
    assert empty.columns == ["a", "b"]


def test_catalog_metadata(spark):
    spark.sql("DROP VIEW IF EXISTS meta_view")
    spark.sql("DROP TABLE IF EXISTS meta_table")
    spark.sql("CREATE TABLE meta_table (id BIGINT NOT NULL, name STRING) USING parquet")
    spark.sql("CREATE VIEW meta_view AS SELECT id FROM meta_table")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION meta_fn(a INT, b STRING) RETURNS STRING RETURN concat(a, b)")
    try:
        tables, columns = metadata.catalog_tables(spark)
        mine = lambda df: df.where(F.col("table_name").startswith("meta_"))
        assert cells(mine(metadata.table_list(tables, columns)), "table_name", "column_count", "row_count") == [("meta_table", 2, None)]
        spark.sql("INSERT INTO meta_table VALUES (1, 'a'), (2, 'b')")
        counted = metadata.with_row_counts(tables.where("table_name like 'meta%'"))
        assert cells(metadata.table_list(counted, columns), "table_name", "row_count") == [("meta_table", 2)]
        assert cells(mine(metadata.view_list(tables, columns)), "table_name", "definition") == [("meta_view", "SELECT id FROM meta_table")]
        assert cells(mine(columns), "table_name", "column_name", "data_type", "position") == [
            ("meta_table", "id", "bigint", 1), ("meta_table", "name", "string", 2), ("meta_view", "id", "bigint", 1),
        ]
        found = [r for r in metadata.catalog_routines(spark).collect() if r.routine_name == "meta_fn"]
        assert len(found) == 1 and found[0].parameter_count == 2 and "STRING" in found[0].return_type.upper()
    finally:
        spark.sql("DROP VIEW meta_view")
        spark.sql("DROP TABLE meta_table")


def test_composite_references_do_not_multiply(spark):
    at = ("s", "details", "fk", "foreign")
    keys = spark.createDataFrame(
        [
            (*at, "product", 2, "s", "items", "p_id", "NO ACTION", "CASCADE", False),
            (*at, "order", 1, "s", "items", "o_id", "NO ACTION", "CASCADE", False),
            ("s", "details", "pk", "primary", "order", 1, None, None, None, None, None, True),
        ],
        schemas.META_KEYS,
    )
    assert cells(metadata.foreign_key_list(keys), "columns", "ref_columns", "on_delete") == [(["order", "product"], ["o_id", "p_id"], "CASCADE")]
    assert cells(metadata.index_list(keys), "constraint_name", "columns", "is_primary") == [("pk", ["order"], True)]


def test_truncate_and_teardown(spark, rows):
    for name in ("td_keep", "td_drop"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.sql(f"CREATE TABLE {name} USING parquet AS SELECT 1 AS a")
    spark.sql("CREATE OR REPLACE VIEW td_view AS SELECT 1 AS a")
    try:
        names = rows("table_name string", ("td_keep",), ("td_drop",), ("__ledger_ops",))
        plan = teardown.truncate_plan(names, preserve=["td_keep"])
        assert cells(plan, "table_name", "action") == [("__ledger_ops", "preserved"), ("td_drop", "truncated"), ("td_keep", "preserved")]
        assert cells(teardown.truncate_plan(names, only=["td_keep", "__ledger_ops"]).where("action = 'truncated'"), "table_name") == [("td_keep",)]
        assert teardown.run_plan(plan, dry_run=True) == ["TRUNCATE TABLE `td_drop`"] and spark.table("td_drop").count() == 1
        teardown.run_plan(plan)
        assert spark.table("td_drop").count() == 0 and spark.table("td_keep").count() == 1

        objects = rows(
            "kind string, name string, table_name string",
            ("table", "td_drop", None), ("table", "td_keep", None), ("view", "td_view", None), ("foreign_key", "fk", "td_keep"), ("table", "__ledger_ops", None),
        )
        down = teardown.teardown_plan(objects, preserve_tables=["td_keep"])
        assert teardown.run_plan(down) == ["DROP VIEW IF EXISTS `td_view`", "DROP TABLE IF EXISTS `td_drop`"]
        assert spark.catalog.tableExists("td_keep") and not spark.catalog.tableExists("td_drop") and not spark.catalog.tableExists("td_view")
        assert teardown.run_plan(teardown.teardown_plan(objects, keep_kinds=["view", "table"]), dry_run=True)[0].startswith("ALTER TABLE `td_keep`")

        ops = spark.createDataFrame([(7, "a", "change", "change", "h", day(1), "me", "prod", "1", "success", "", 1)], schemas.OPERATIONS)
        after = {r.id: r for r in teardown.ledger_after_teardown(ops, down, "prod", "me", F.lit(day(2))).collect()}
        assert after[7].status == "stale"
        assert after[8].error_message == "Schema teardown: dropped 1 tables, 1 views, 0 functions, 0 procedures"
    finally:
        for name in ("td_keep", "td_drop"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


class Session:
    """As much of a session as the choice of a folder needs."""

    def __init__(self, folder, master):
        self.conf = type("Conf", (), {"get": lambda _, key, default: folder})()
        self.sparkContext = type("Context", (), {"master": master})()


def test_shared_folder():
    assert session.shared_dir(Session("/shared", "yarn")) == "/shared"
    assert session.shared_dir(Session(None, "local[8]")) == session.shared_dir(Session(None, "local[8]"))
    with pytest.raises(RuntimeError):
        session.shared_dir(Session(None, "yarn"))
    assert session.scratch_path(Session("/shared", "yarn"), "x").startswith("/shared/x-")


def test_catalog_statistics(spark, rows, monkeypatch):
    database = "statistics_of_tests"
    spark.sql(f"DROP DATABASE IF EXISTS {database} CASCADE")
    spark.sql(f"CREATE DATABASE {database}")
    try:
        for name, n in (("stat_many", 120), ("stat_none", 0), ("stat_other", 3)):
            spark.range(n).selectExpr("id", "id % 3 AS part").write.saveAsTable(f"{database}.{name}")
        spark.sql(f"CREATE VIEW {database}.stat_seen AS SELECT id FROM {database}.stat_many")
        at = ["table_name", "kind", "column_count", "row_estimate", "definition"]
        before = {r.table_name: r for r in metadata.catalog_statistics(spark, database, "stat_*").collect()}
        assert set(before) == {"stat_many", "stat_none", "stat_other", "stat_seen"} and before["stat_seen"].kind == "view" and before["stat_many"].row_estimate is None
        metadata.analyze(spark, database, "stat_many|stat_none")
        got = cells(metadata.catalog_statistics(spark, database, "stat_*"), *at)
        assert got == [
            ("stat_many", "table", 2, 120, None), ("stat_none", "table", 2, 0, None), ("stat_other", "table", 2, None, None), ("stat_seen", "view", 1, None, f"SELECT id FROM {database}.stat_many"),
        ]
        assert cells(metadata.estimated_table_list(metadata.catalog_statistics(spark, database, "stat_*")), "table_name", "row_estimate") == [("stat_many", 120), ("stat_none", None), ("stat_other", None)]
        assert cells(metadata.catalog_statistics(spark, database, "stat_o*"), "table_name") == [("stat_other",)]
        described = []
        describe = metadata.describe
        monkeypatch.setattr(metadata, "describe", lambda s, table: described.append(table) or describe(s, table))
        tables, columns = metadata.catalog_tables(spark, database, "stat_o*")
        assert len(described) == 1 and cells(tables, "table_name") == [("stat_other",)] and columns.count() == 2
    finally:
        spark.sql(f"DROP DATABASE {database} CASCADE")


@pytest.mark.parametrize("key", [None, "id"])
def test_levels_of_a_recursive_statement_are_not_broadcast(spark, key):
    """Broadcasts fail; chains of four, with a key that comes twice and one that is null."""
    rows = spark.range(40).union(spark.createDataFrame([(2,), (None,)], "id BIGINT"))
    results.create_step_view(rows, "steps", key)
    results.lift_recursion_limits(spark)
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1b")
    try:
        got = spark.sql("""
            WITH RECURSIVE chain(id, level) AS (
              SELECT id, 0 FROM steps WHERE id % 4 = 0
              UNION ALL SELECT s.id, level + 1 FROM steps s JOIN chain ON s.id = chain.id + 1 AND s.id % 4 <> 0)
            SELECT level, count(*) AS n, min(id) AS first_id FROM chain GROUP BY level""")
        assert sorted(tuple(r) for r in got.collect()) == [(0, 10, 0), (1, 10, 1), (2, 11, 2), (3, 11, 3)]
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
        spark.catalog.clearCache()
