"""Mutations, audit and constraint checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.operators import constraints, mutate, relational
from ledgerlake.plans import roles
from ledgerlake.plans.registry import Tables, query
from ledgerlake.plans.relational_queries import TREE_SQL, _tree
from ledgerlake.plans.roles import AS_OF, with_todo
from ledgerlake.session import scratch_path
from ledgerlake.sources.versions import VersionedTable

STAMP = f"TIMESTAMP '{AS_OF}'"
SHIFT = 1_000_000_000_000  # keeps the keys of new rows apart from those of the table

# --- insert ----------------------------------------------------------------------------------------------------------


def _new_lists(t: Tables) -> DataFrame:
    return t.events.where(F.col("event_type") == "signup").select(
        (F.col("event_id") + SHIFT).alias("id"),
        "user_id",
        F.concat(F.lit("New "), F.col("event_id")).alias("title"),
        F.when(F.col("value") > 20, "#00FF00").alias("color"),
    )


@query(
    "M1 A10",
    with_todo(f"""
, fresh AS (
  SELECT event_id + {SHIFT} AS id, e.user_id, 'New ' || event_id AS title, coalesce(CASE WHEN value > 20 THEN '#00FF00' END, '#000000') AS color,
         coalesce(b.base, 0) + row_number() OVER (PARTITION BY e.user_id ORDER BY event_id) - 1 AS position
  FROM events e LEFT JOIN (SELECT user_id, max(position) + 1 AS base FROM lists WHERE deleted_at IS NULL GROUP BY user_id) b
    ON b.user_id = e.user_id
  WHERE event_type = 'signup')
SELECT id, user_id, title, color, CAST(position AS INTEGER) AS position, created_at FROM lists
UNION ALL SELECT id, user_id, title, color, CAST(position AS INTEGER), {STAMP} FROM fresh"""),
)
def m1_insert_lists(t: Tables) -> DataFrame:
    lists = roles.lists(t)
    placed = mutate.with_positions(lists, _new_lists(t), "user_id", ["id"])
    defaults = {"color": F.lit("#000000"), "created_at": roles.as_of(), "updated_at": roles.as_of()}
    return mutate.insert(lists, placed, defaults).select("id", "user_id", "title", "color", "position", "created_at")


# --- update ----------------------------------------------------------------------------------------------------------


def _patches(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    return t.events.where(kind != "view").select(
        F.col("user_id").alias("id"),
        F.col("event_id").alias("seq"),
        F.when(kind == "click", F.concat(F.lit("T"), F.col("event_id"))).alias("title"),
        F.when((kind == "purchase") & (F.col("value") > 40), F.concat(F.lit("#"), F.col("event_id"))).alias("color"),
    )


@query(
    "M2",
    with_todo(f"""
, patches AS (
  SELECT user_id AS id, arg_max(CASE WHEN event_type = 'click' THEN 'T' || event_id END, event_id) AS title,
         arg_max(CASE WHEN event_type = 'purchase' AND value > 40 THEN '#' || event_id END, event_id) AS color
  FROM events WHERE event_type <> 'view' GROUP BY user_id)
SELECT l.id, CASE WHEN l.deleted_at IS NULL THEN coalesce(p.title, l.title) ELSE l.title END AS title,
       CASE WHEN l.deleted_at IS NULL THEN coalesce(p.color, l.color) ELSE l.color END AS color,
       CASE WHEN l.deleted_at IS NULL AND p.id IS NOT NULL THEN {STAMP} ELSE l.updated_at END AS updated_at
FROM lists l LEFT JOIN patches p ON p.id = l.id"""),
)
def m2_patch_lists(t: Tables) -> DataFrame:
    patched = mutate.patch(roles.lists(t), _patches(t), "id", ["title", "color"], roles.as_of(), seq="seq")
    return patched.select("id", "title", "color", "updated_at")


@query(
    "M3",
    with_todo(f"""
SELECT id, CASE WHEN hit THEN {STAMP} ELSE updated_at END AS updated_at, CASE WHEN hit THEN {STAMP} ELSE deleted_at END AS deleted_at
FROM (SELECT *, deleted_at IS NULL AND id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS hit FROM lists)"""),
)
def m3_soft_delete(t: Tables) -> DataFrame:
    keys = t.lineitem.where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("id"))
    return mutate.soft_delete(roles.lists(t), keys, "id", roles.as_of()).select("id", "updated_at", "deleted_at")


@query(
    "M4",
    f"""
WITH todo AS (
  SELECT o_orderkey AS id, o_orderstatus = 'F' AS is_completed, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS completed_at,
         o_orderdate AS updated_at, CASE WHEN o_orderpriority = '5-LOW' THEN o_orderdate END AS deleted_at FROM orders)
, clicks AS (SELECT l_orderkey AS id, count(*) AS times FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)
, flipped AS (
  SELECT t.*, c.id IS NOT NULL AND deleted_at IS NULL AS hit, CASE WHEN times % 2 = 1 THEN NOT is_completed ELSE is_completed END AS now_done
  FROM todo t LEFT JOIN clicks c ON c.id = t.id)
SELECT id, CASE WHEN hit THEN now_done ELSE is_completed END AS is_completed,
       CASE WHEN hit THEN CASE WHEN now_done THEN {STAMP} END ELSE completed_at END AS completed_at,
       CASE WHEN hit THEN {STAMP} ELSE updated_at END AS updated_at
FROM flipped""",
)
def m4_toggle_completed(t: Tables) -> DataFrame:
    done = F.col("o_orderstatus") == "F"
    todo = t.orders.select(
        F.col("o_orderkey").alias("id"),
        done.alias("is_completed"),
        F.when(done, F.col("o_orderdate")).alias("completed_at"),
        F.col("o_orderdate").alias("updated_at"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_orderdate")).alias("deleted_at"),
    )
    keys = t.lineitem.where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("id"))
    return mutate.toggle(todo, keys, "id", roles.as_of()).drop("deleted_at")


# --- delete ----------------------------------------------------------------------------------------------------------


@query("M5", with_todo("SELECT id, color FROM lists WHERE color IS NULL OR color <> '#FF0000'"))
def m5_delete_kept(t: Tables) -> DataFrame:
    return mutate.delete_where(roles.lists(t).select("id", "color"), F.col("color") == "#FF0000")[0]


@query("M5", with_todo("SELECT id, title, color FROM lists WHERE color = '#FF0000'"))
def m5_delete_returning(t: Tables) -> DataFrame:
    return mutate.delete_where(roles.lists(t), F.col("color") == "#FF0000")[1].select("id", "title", "color")


@query(
    "M6",
    with_todo("""
, gone_users AS (SELECT id FROM users WHERE deleted_at IS NOT NULL)
, gone_lists AS (SELECT id FROM lists WHERE user_id IN (SELECT id FROM gone_users))
SELECT 'users' AS "table", id, NULL AS part_id FROM users WHERE id NOT IN (SELECT id FROM gone_users)
UNION ALL SELECT 'lists', id, NULL FROM lists WHERE id NOT IN (SELECT id FROM gone_lists)
UNION ALL SELECT 'items', list_id, part_id FROM items WHERE list_id NOT IN (SELECT id FROM gone_lists)"""),
)
def m6_cascade_delete(t: Tables) -> DataFrame:
    tables = {"users": roles.users(t), "lists": roles.lists(t), "items": roles.items(t)}
    references = [mutate.Reference("lists", "user_id", "users"), mutate.Reference("items", "list_id", "lists")]
    removed = tables["users"].where(F.col("deleted_at").isNotNull()).select("id")
    kept = mutate.cascade_delete(tables, {"users": "id", "lists": "id", "items": "list_id"}, references, "users", removed)
    none = F.lit(None).cast("bigint").alias("part_id")
    left = [kept[n].select(F.lit(n).alias("table"), "id", none) for n in ("users", "lists")]
    return left[0].unionByName(left[1]).unionByName(kept["items"].select(F.lit("items").alias("table"), F.col("list_id").alias("id"), "part_id"))


@query(
    "M6 U3",
    f"""
WITH RECURSIVE {TREE_SQL},
gone AS (
  SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0
  UNION
  SELECT t.id FROM tree t JOIN gone g ON t.manager = g.id)
SELECT id, name FROM tree WHERE id NOT IN (SELECT id FROM gone)""",
)
def m6_cascade_self_reference(t: Tables) -> DataFrame:
    removed = t.customer.where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("id"))
    own = [mutate.Reference("tree", "manager", "tree")]
    kept = mutate.cascade_delete({"tree": _tree(t)}, {"tree": "id"}, own, "tree", removed)
    return kept["tree"].select("id", "name")


# --- upsert and audit ------------------------------------------------------------------------------------------------


@query(
    "M7",
    f"""
WITH existing AS (
  SELECT sha256('user ' || c_custkey) AS identity_hash, c_name AS name, 'old' AS machine, TIMESTAMP '2024-01-01 00:00:00' AS registered_at,
         TIMESTAMP '2024-01-01 00:00:00' AS last_seen_at
  FROM customer WHERE c_acctbal >= 1000)
, incoming AS (
  SELECT sha256('user ' || user_id) AS identity_hash, arg_min('user ' || user_id, event_id) AS name, arg_min('m' || props, event_id) AS machine
  FROM events GROUP BY user_id)
SELECT coalesce(e.identity_hash, i.identity_hash) AS identity_hash, coalesce(e.name, i.name) AS name, coalesce(e.machine, i.machine) AS machine,
       coalesce(e.registered_at, {STAMP}) AS registered_at, CASE WHEN i.identity_hash IS NULL THEN e.last_seen_at ELSE {STAMP} END AS last_seen_at
FROM existing e FULL OUTER JOIN incoming i ON i.identity_hash = e.identity_hash""",
)
def m7_register_identities(t: Tables) -> DataFrame:
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    existing = t.customer.where(F.col("c_acctbal") >= 1000).select(
        F.sha2(F.concat(F.lit("user "), "c_custkey"), 256).alias("identity_hash"),
        F.col("c_name").alias("name"),
        F.lit("old").alias("machine"),
        start.alias("registered_at"),
        start.alias("last_seen_at"),
    )
    person = F.concat(F.lit("user "), F.col("user_id"))
    incoming = t.events.select(
        F.sha2(person, 256).alias("identity_hash"),
        person.alias("name"),
        F.concat(F.lit("m"), "props").alias("machine"),
        F.col("event_id").alias("seq"),
    )
    return mutate.upsert_first_wins(existing, incoming, "identity_hash", "seq", roles.as_of())


def _image(name: str, segment: str) -> str:
    return f"""'{{"id":' || id || ',"name":"' || {name} || '","segment":' || coalesce('"' || {segment} || '"', 'null') || '}}'"""


IMAGES_SQL = f"""
WITH old AS (SELECT c_custkey AS id, c_name AS name, nullif(c_mktsegment, 'FURNITURE') AS segment FROM customer)
, new AS (
  SELECT id, name, CASE WHEN segment = 'BUILDING' THEN 'REBUILT' ELSE segment END AS segment FROM old
  WHERE segment IS NULL OR segment <> 'MACHINERY'
  UNION ALL SELECT s_suppkey + {SHIFT}, s_name, NULL FROM supplier)
, images AS (
  SELECT CAST(coalesce(o.id, n.id) AS VARCHAR) AS row_id, o.image AS old_data, n.image AS new_data
  FROM (SELECT id, {_image("name", "segment")} AS image FROM old) o
  FULL OUTER JOIN (SELECT id, {_image("name", "segment")} AS image FROM new) n ON n.id = o.id)
"""


def _snapshots(t: Tables) -> tuple[DataFrame, DataFrame]:
    old = t.customer.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.nullif("c_mktsegment", F.lit("FURNITURE")).alias("segment")
    )
    kept, _ = mutate.delete_where(old, F.col("segment") == "MACHINERY")
    rebuilt = F.when(F.col("segment") == "BUILDING", "REBUILT").otherwise(F.col("segment"))
    added = t.supplier.select((F.col("s_suppkey") + SHIFT).alias("id"), F.col("s_name").alias("name"))
    return old, mutate.insert(kept.withColumn("segment", rebuilt), added)


@query("J12", IMAGES_SQL + "SELECT * FROM images")
def j12_matched_images(t: Tables) -> DataFrame:
    return mutate.matched_images(*_snapshots(t), "id")


AUDIT_SQL = (
    IMAGES_SQL
    + f"""
SELECT 'users' AS table_name, CASE WHEN old_data IS NULL THEN 'INSERT' WHEN new_data IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS operation,
       row_id, old_data, new_data, {STAMP} AS changed_at
FROM images WHERE old_data IS DISTINCT FROM new_data"""
)


@query("M9", AUDIT_SQL)
def m9_audit_changes(t: Tables) -> DataFrame:
    return mutate.audit(*_snapshots(t), "id", "users", roles.as_of())


# --- versions --------------------------------------------------------------------------------------------------------


@query("M9 M5 M1", AUDIT_SQL)
def m9_audit_between_versions(t: Tables) -> DataFrame:
    """The same steps as commits of a stored table; the audit compares the first version with the last before a later change."""
    table = VersionedTable(t.spark, scratch_path(t.spark, "users"))
    first, last = _snapshots(t)
    table.append(first.where("id % 2 = 0"))
    created = table.append(first.where("id % 2 = 1 OR id IS NULL"))
    changed = table.replace(last, created, "change users")
    table.update(lambda users: mutate.delete_where(users, F.lit(True))[0], "clear users")
    return table.changes(created.number, changed.number, "id", "users", roles.as_of())


@query(
    "M2 M3",
    with_todo(f"""
, patches AS (
  SELECT user_id AS id, arg_max(CASE WHEN event_type = 'click' THEN 'T' || event_id END, event_id) AS title FROM events WHERE event_type <> 'view' GROUP BY user_id)
, patched AS (
  SELECT l.id, CASE WHEN l.deleted_at IS NULL THEN coalesce(p.title, l.title) ELSE l.title END AS title, l.deleted_at,
         CASE WHEN l.deleted_at IS NULL AND p.id IS NOT NULL THEN {STAMP} ELSE l.updated_at END AS updated_at
  FROM lists l LEFT JOIN patches p ON p.id = l.id)
, gone AS (SELECT *, deleted_at IS NULL AND id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS hit FROM patched)
SELECT 1 AS version, 'patch' AS operation, id, title, updated_at, deleted_at FROM patched
UNION ALL SELECT 2, 'soft delete', id, title, CASE WHEN hit THEN {STAMP} ELSE updated_at END, CASE WHEN hit THEN {STAMP} ELSE deleted_at END FROM gone"""),
)
def m2_versions_of_lists(t: Tables) -> DataFrame:
    """Two mutations of a stored table, each a commit; both versions are read afterwards."""
    table = VersionedTable(t.spark, scratch_path(t.spark, "lists"))
    table.append(roles.lists(t).select("id", "title", "updated_at", "deleted_at"))
    table.update(lambda lists: mutate.patch(lists, _patches(t), "id", ["title"], roles.as_of(), seq="seq"), "patch")
    keys = t.lineitem.where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("id"))
    table.update(lambda lists: mutate.soft_delete(lists, keys, "id", roles.as_of()), "soft delete")

    def read(number: int) -> DataFrame:
        version = table.version(number)
        return table.read(number).select(F.lit(version.number).alias("version"), F.lit(version.operation).alias("operation"), "id", "title", "updated_at", "deleted_at")

    return read(1).unionByName(read(2))


# --- constraints -----------------------------------------------------------------------------------------------------


@query(
    "C1",
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
)
def c1_duplicate_composite_keys(t: Tables) -> DataFrame:
    return constraints.primary_key_violations(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "C1",
    with_todo("""
SELECT user_id, color, count(*) AS n FROM lists WHERE user_id IS NOT NULL AND color IS NOT NULL GROUP BY user_id, color HAVING count(*) > 1"""),
)
def c1_unique_ignores_nulls(t: Tables) -> DataFrame:
    return constraints.unique_violations(roles.lists(t), ["user_id", "color"])


@query(
    "C2",
    with_todo("""
SELECT list_id, count(*) AS n FROM items WHERE list_id NOT IN (SELECT id FROM lists WHERE deleted_at IS NULL) GROUP BY list_id"""),
)
def c2_missing_parents(t: Tables) -> DataFrame:
    live = relational.active(roles.lists(t))
    return constraints.reference_violations(roles.items(t), ["list_id"], live, ["id"])


@query(
    "C2",
    with_todo("""
SELECT user_id, color, count(*) AS n FROM lists l
WHERE user_id IS NOT NULL AND color IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM users u WHERE u.id = l.user_id AND CASE WHEN u.nation_id < 12 THEN '#FF0000' END = l.color)
GROUP BY user_id, color"""),
)
def c2_missing_composite_parents(t: Tables) -> DataFrame:
    parents = roles.users(t).select("id", F.when(F.col("nation_id") < 12, "#FF0000").alias("color"))
    return constraints.reference_violations(roles.lists(t), ["user_id", "color"], parents, ["id", "color"])


@query(
    "C3",
    with_todo("""
SELECT list_id, position, 'completed_at is not null' AS rule FROM items WHERE completed_at IS NULL
UNION ALL SELECT list_id, position, 'priority between 0 and 3' FROM items WHERE NOT (priority BETWEEN 0 AND 3)
UNION ALL SELECT list_id, position, 'deleted after completed' FROM items WHERE NOT (deleted_at > completed_at)"""),
)
def c3_check_violations(t: Tables) -> DataFrame:
    checks = {
        "priority between 0 and 3": F.col("priority").between(0, 3),
        "deleted after completed": F.col("deleted_at") > F.col("completed_at"),
    }
    broken = constraints.check_violations(roles.items(t), ["completed_at"], checks)
    return broken.select("list_id", "position", "rule")
