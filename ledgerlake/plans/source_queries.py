"""Sources, stored results, raw SQL, and SQL functions."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions import routines
from ledgerlake.operators import corpus
from ledgerlake.plans import roles
from ledgerlake.plans.registry import Tables, query
from ledgerlake.plans.roles import with_todo
from ledgerlake.session import materialize, scratch_path
from ledgerlake.sources import corpus_files, results, seeds


@query(
    "S1",
    """
SELECT CAST(c_custkey AS VARCHAR) AS id, c_name || ', "the ' || lower(c_mktsegment) || '"' AS name,
       coalesce(nullif(c_mktsegment, 'FURNITURE'), '') AS segment
FROM customer""",
)
def s1_csv_seed(t: Tables) -> DataFrame:
    """Rows written as CSV with padded names and cells, read back as trimmed strings."""
    segment = F.col("c_mktsegment")
    rows = t.customer.select(
        F.concat(F.lit("  "), F.col("c_custkey"), F.lit(" ")).alias("id"),
        F.concat("c_name", F.lit(', "the '), F.lower(segment), F.lit('"')).alias(" name "),
        F.when(segment != "FURNITURE", F.concat(segment, F.lit("  "))).alias("segment"),
    )
    path = scratch_path(t.spark, "csv")
    rows.write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return seeds.read_csv_seed(t.spark, path)


@query("S2", "SELECT event_id AS id, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k, event_type || ', // not a comment' AS kind FROM events")
def s2_json5_documents(t: Tables) -> DataFrame:
    """Relaxed JSON, a document a line, written as files and read as seeds: comments, unquoted keys, single quotes and trailing commas."""
    text = F.concat(
        F.lit("{ id: "), F.col("event_id"), F.lit(", /* from props */ 'k': "), F.get_json_object("props", "$.k"),
        F.lit(", kind: '"), F.col("event_type"), F.lit(", // not a comment',}"),
    )
    path = scratch_path(t.spark, "json5")
    t.events.select(text.alias("value")).write.text(path)
    return seeds.read_json_seed(t.spark, path, "id BIGINT, k INT, kind STRING", per_line=True)


@query(
    "S4",
    """
SELECT n_nationkey AS nation, sha256(string_agg('INSERT INTO c VALUES (' || c_custkey || ');', chr(10) ORDER BY c_custkey) || chr(10)) AS checksum
FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_nationkey""",
)
def s4_script_files(t: Tables) -> DataFrame:
    """A script file per nation, written and read back whole; the writer's own suffix stands for that of scripts."""
    path = scratch_path(t.spark, "scripts")
    text = F.concat(F.lit("INSERT INTO c VALUES ("), F.col("c_custkey"), F.lit(");"))
    rows = t.customer.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey")
    rows.select(text.alias("value"), F.col("c_nationkey").alias("nation")).write.partitionBy("nation").text(path)
    files = corpus.fingerprinted(corpus_files.read_scripts(t.spark, path, suffixes=(".txt",)))
    return files.select(F.regexp_extract("path", r"nation=(\d+)", 1).cast("int").alias("nation"), "checksum")


@query("S6", "SELECT n_nationkey AS id, n_name AS name, '[\"read\",\"' || lower(r_name) || '\"]' AS permissions FROM nation JOIN region ON r_regionkey = n_regionkey")
def s6_seed_insert(t: Tables) -> DataFrame:
    """Seed rows with a list column, appended as JSON text."""
    regions = t.region.select(F.col("r_regionkey").alias("n_regionkey"), F.array(F.lit("read"), F.lower("r_name")).alias("permissions"))
    rows = t.nation.join(regions, "n_regionkey").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), "permissions")
    path = scratch_path(t.spark, "roles")
    table = f"seed_{uuid.uuid4().hex}"
    t.spark.sql(f"CREATE TABLE {table} (id INT, name STRING, permissions STRING) USING parquet LOCATION '{path}'")
    seeds.append_rows(rows, table, ["id", "name", "permissions"])
    return t.spark.table(table)


@query("S7", with_todo("SELECT id, title, color, position, created_at FROM lists"))
def s7_saved_results(t: Tables) -> DataFrame:
    folder = scratch_path(t.spark, "results")
    results.save_result(roles.lists(t).select("id", "title", "color", "position", "created_at"), folder, "first")
    return results.load_result(t.spark, folder, "first")


RECORDED = "SELECT o_orderkey, o_custkey FROM recorded_orders WHERE o_totalprice > :least"


@query("S8", "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 1000")
def s8_recorded_query(t: Tables) -> DataFrame:
    """A statement run, stored and entered in the history; its rows are read from where the history says."""
    t.orders.createOrReplaceTempView("recorded_orders")
    history, folder = scratch_path(t.spark, "history"), scratch_path(t.spark, "results")
    results.record_sql(t.spark, RECORDED, history, folder, {"least": 1000})
    stored = results.recent(t.spark, history, 1).first()["results_path"]
    return results.load_result(t.spark, *stored.rsplit("/", 1))


@query("A15", "SELECT 3 AS entry_count, true AS stored, count(*) AS row_count FROM orders WHERE o_totalprice > 1000")
def a15_history_stats(t: Tables) -> DataFrame:
    """Three statements, one of which fails: entries and stored bytes, beside the largest recorded count."""
    t.orders.createOrReplaceTempView("recorded_orders")
    history, folder = scratch_path(t.spark, "history"), scratch_path(t.spark, "results")
    for text in (RECORDED, "SELECT count(*) AS n FROM recorded_orders WHERE o_totalprice > :least", "SELECT nothing FROM recorded_orders"):
        results.record_sql(t.spark, text, history, folder, {"least": 1000})
    most = results.recent(t.spark, history).agg(F.max("row_count").alias("row_count"))
    stats = results.history_stats(t.spark, history, folder)
    return stats.select("entry_count", (F.col("results_size") > 0).alias("stored"), most.scalar().alias("row_count"))


@query("S9", "SELECT o_orderpriority, count(*) AS orders FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority")
def s9_raw_sql(t: Tables) -> DataFrame:
    t.orders.createOrReplaceTempView("raw_orders")
    text = "SELECT o_orderpriority, count(*) AS orders FROM raw_orders WHERE o_orderstatus = :status GROUP BY o_orderpriority"
    return results.run_sql(t.spark, text, {"status": "F"}).rows


@query(
    "U3 S9",
    """
WITH RECURSIVE chain AS (
  SELECT c_custkey AS id, 0 AS level FROM customer WHERE c_custkey = 0
  UNION ALL SELECT c.c_custkey, level + 1 FROM customer c JOIN chain ON c.c_custkey // 8 = chain.id AND c.c_custkey > 0)
SELECT level, count(*) AS employees FROM chain GROUP BY level""",
)
def u3_recursive_sql(t: Tables) -> DataFrame:
    """The recursive statement itself, passed through as text; the limits of recursion are lifted for the session."""
    results.create_step_view(t.customer, "employees")
    text = """
        WITH RECURSIVE chain(id, level) AS (
          SELECT c_custkey, 0 FROM employees WHERE c_custkey = 0
          UNION ALL SELECT c.c_custkey, level + 1 FROM employees c JOIN chain ON c.c_custkey div 8 = chain.id AND c.c_custkey > 0)
        SELECT level, count(*) AS employees FROM chain GROUP BY level"""
    results.lift_recursion_limits(t.spark)
    return t.spark.sql(text)


@query(
    "U3 S9",
    """
WITH RECURSIVE chain AS (
  SELECT p_partkey AS id, 0 AS level FROM part WHERE p_partkey % 160 = 1
  UNION ALL SELECT p.p_partkey, level + 1 FROM part p JOIN chain ON p.p_partkey = chain.id + 1 AND p.p_partkey % 160 <> 1)
SELECT level, count(*) AS parts, min(id) AS first_id FROM chain GROUP BY level""",
)
def u3_deep_recursive_sql(t: Tables) -> DataFrame:
    """Chains of 160 levels, as text."""
    results.create_step_view(t.part.select("p_partkey"), "deep_parts", "p_partkey")
    text = """
        WITH RECURSIVE chain(id, level) AS (
          SELECT p_partkey, 0 FROM deep_parts WHERE p_partkey % 160 = 1
          UNION ALL SELECT p.p_partkey, level + 1 FROM deep_parts p JOIN chain ON p.p_partkey = chain.id + 1 AND p.p_partkey % 160 <> 1)
        SELECT level, count(*) AS parts, min(id) AS first_id FROM chain GROUP BY level"""
    results.lift_recursion_limits(t.spark)
    return t.spark.sql(text)


@query(
    "D1 F5 F6 F7",
    with_todo("""
SELECT l.id, CASE WHEN strpos(u.email, '@') > 0 AND strpos(substr(u.email, strpos(u.email, '@')), '.') > 0 THEN true ELSE false END AS valid_email,
       coalesce(regexp_matches(l.color, '^#[0-9A-Fa-f]{6}$'), true) AS valid_color,
       CASE position % 5 WHEN 0 THEN 'None' WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' WHEN 3 THEN 'High' ELSE 'Unknown' END AS label
FROM lists l JOIN users u ON u.id = l.user_id"""),
)
def d1_scalar_functions(t: Tables) -> DataFrame:
    routines.create_scalar_functions(t.spark)
    users = roles.users(t).select(F.col("id").alias("user_id"), "email")
    return roles.lists(t).join(users, "user_id").select(
        "id",
        F.expr("is_valid_email(email)").alias("valid_email"),
        F.expr("is_valid_hex_color(color)").alias("valid_color"),
        F.expr("priority_label(position % 5)").alias("label"),
    )


@query("D2", with_todo("SELECT id, title, position FROM lists WHERE user_id = 11 AND deleted_at IS NULL ORDER BY position"))
def d2_table_function(t: Tables) -> DataFrame:
    roles.lists(t).createOrReplaceTempView("todo_lists")
    roles.users(t).createOrReplaceTempView("users")
    routines.create_table_functions(t.spark)
    return t.spark.sql("SELECT id, title, position FROM lists_of_user(11) ORDER BY position")


def _procedure_lists(t: Tables) -> DataFrame:
    return roles.lists(t).select("id", "user_id", "title", "color", F.col("position").cast("int").alias("position"), "updated_at", "deleted_at")


@query(
    "D3 A10",
    with_todo(f"""
, chosen AS (SELECT min(l.user_id) AS user_id FROM lists l JOIN users u ON u.id = l.user_id AND u.deleted_at IS NULL WHERE l.deleted_at IS NULL)
, own AS (SELECT l.* FROM lists l JOIN chosen USING (user_id) WHERE l.deleted_at IS NULL)
SELECT id, title, color, CAST(position AS INTEGER) AS position FROM own WHERE id <> (SELECT min(id) FROM own)
UNION ALL SELECT -1, 'Renamed', '#00FF00', CAST(max(position) + 1 AS INTEGER) FROM own"""),
)
def d3_create_list(t: Tables) -> DataFrame:
    """Procedures that write: a list is made at the next position and renamed, the user's first list is deleted; then a query."""
    spark = t.spark
    roles.users(t).createOrReplaceTempView("users")
    lists = _procedure_lists(t)
    active = lists.where("deleted_at IS NULL").join(roles.users(t).where("deleted_at IS NULL").select(F.col("id").alias("user_id")), "user_id", "left_semi")
    user = active.agg(F.min("user_id")).first()[0]
    first = active.where(F.col("user_id") == user).agg(F.min("id")).first()[0]
    at = datetime.fromisoformat(roles.AS_OF)
    with routines.changed_table(lists, "todo_lists", "id", scratch_path(spark, "todo-lists")) as tables:
        routines.call(spark, "create_todo_list", tables, id=-1, user=user, title="New", color="#00FF00", as_of=at)
        routines.call(spark, "update_todo_list", tables, id=-1, title="Renamed", color=None, as_of=at)
        routines.call(spark, "delete_todo_list", tables, id=first, as_of=at)
        made = routines.call(spark, "get_todo_lists_by_user", tables, user=user).drop("updated_at")
        return materialize(made, "lists-of-user")


@query(
    "D3 M1",
    with_todo("""
, incoming AS (SELECT -event_id - 1 AS id, user_id, 'New ' || event_id AS title FROM events WHERE event_type = 'signup')
SELECT i.id, i.user_id, i.title, CAST(coalesce(b.base, 0) + row_number() OVER (PARTITION BY i.user_id ORDER BY i.id) - 1 AS INTEGER) AS position
FROM incoming i JOIN users u ON u.id = i.user_id AND u.deleted_at IS NULL
LEFT JOIN (SELECT user_id, max(position) + 1 AS base FROM lists WHERE deleted_at IS NULL GROUP BY user_id) b ON b.user_id = i.user_id"""),
)
def d3_import_lists(t: Tables) -> DataFrame:
    """A procedure over sets: every new list gets its place, or none is made."""
    spark = t.spark
    roles.users(t).createOrReplaceTempView("users")
    text = F.concat(F.lit("New "), F.col("event_id"))
    t.events.where("event_type = 'signup'").select((-F.col("event_id") - 1).alias("id"), "user_id", text.alias("title"), F.lit(None).cast("string").alias("color")).createOrReplaceTempView("incoming")
    with routines.changed_table(_procedure_lists(t), "todo_lists", "id", scratch_path(spark, "todo-lists")) as tables:
        routines.call(spark, "import_todo_lists", tables, as_of=datetime.fromisoformat(roles.AS_OF))
        return materialize(spark.table("todo_lists").where("id < 0").select("id", "user_id", "title", "position"), "imported")


@query("D3", with_todo("SELECT id, username FROM users WHERE nation_id = 3 AND deleted_at IS NULL"))
def d3_query_procedure(t: Tables) -> DataFrame:
    roles.users(t).createOrReplaceTempView("users")
    return routines.call(t.spark, "users_of_nation", nation=3)
