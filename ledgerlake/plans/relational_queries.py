"""Views, lookups, joins, aggregates, sorts and functions over users, lists and items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions import scalar
from ledgerlake.operators import hierarchy, kept, ranking, relational
from ledgerlake.plans import roles
from ledgerlake.plans.registry import Tables, query
from ledgerlake.plans.roles import with_todo
from ledgerlake.session import materialize, scratch_path

# --- projection and filter -------------------------------------------------------------------------------------------


@query("P1", with_todo("SELECT id, email, username, display_name, nation_id FROM users WHERE deleted_at IS NULL"))
def p1_active_users(t: Tables) -> DataFrame:
    return relational.active_view(roles.users(t))


@query("P2", with_todo("SELECT id, email, username, display_name, nation_id FROM users WHERE id = 42 AND deleted_at IS NULL"))
def p2_user_by_id(t: Tables) -> DataFrame:
    return relational.lookup(roles.users(t), "id", 42).drop("password_hash", "deleted_at")


@query(
    "P2",
    with_todo(
        "SELECT id, email, username, password_hash, display_name FROM users "
        "WHERE email = 'customer.000000007@example.com' AND deleted_at IS NULL"
    ),
)
def p2_user_by_email(t: Tables) -> DataFrame:
    found = relational.lookup(roles.users(t), "email", "customer.000000007@example.com")
    return found.select("id", "email", "username", "password_hash", "display_name")


@query(
    "P3",
    with_todo("SELECT id, title, color, position FROM lists WHERE user_id = 7 AND deleted_at IS NULL ORDER BY position"),
)
def p3_lists_of_user(t: Tables) -> DataFrame:
    return relational.children_of(roles.lists(t), "user_id", 7, ["position"]).select("id", "title", "color", "position")


@query(
    "P4",
    with_todo("""
SELECT id, title, color FROM lists
WHERE lower(coalesce(CAST(id AS VARCHAR), 'NULL')) LIKE '%ff%' OR lower(coalesce(title, 'NULL')) LIKE '%ff%'
   OR lower(coalesce(color, 'NULL')) LIKE '%ff%'"""),
)
def p4_search_any_column(t: Tables) -> DataFrame:
    return relational.search(roles.lists(t).select("id", "title", "color"), "FF")


@query("P4", with_todo("SELECT id, display_name FROM users WHERE lower(coalesce(display_name, 'NULL')) LIKE '%nu%'"))
def p4_search_one_column(t: Tables) -> DataFrame:
    return relational.search(roles.users(t).select("id", "display_name"), "nu", "display_name")


@query(
    "P7",
    "SELECT p_partkey, p_name FROM part WHERE NOT starts_with(p_name, 'small')",
)
def p7_exclude_internal(t: Tables) -> DataFrame:
    return relational.exclude_prefix(t.part.select("p_partkey", "p_name"), "p_name", "small")


@query("P8", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O')")
def p8_status_in(t: Tables) -> DataFrame:
    return relational.member_of(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O"])


# --- joins -----------------------------------------------------------------------------------------------------------


@query(
    "J1",
    with_todo("""
SELECT i.list_id, i.part_id, i.position, i.priority, i.is_completed, i.completed_at, l.user_id, l.title AS list_title
FROM items i JOIN lists l ON l.id = i.list_id WHERE i.deleted_at IS NULL AND l.deleted_at IS NULL"""),
)
def j1_active_items(t: Tables) -> DataFrame:
    carry = {"user_id": "user_id", "title": "list_title"}
    return relational.join_active(roles.items(t), roles.lists(t), "list_id", "id", carry).drop("deleted_at")


@query("J3", with_todo("SELECT u.username, l.title FROM users u JOIN lists l ON l.user_id = u.id"))
def j3_users_join_lists(t: Tables) -> DataFrame:
    users, lists = roles.users(t), roles.lists(t)
    return users.join(lists, users["id"] == lists["user_id"]).select("username", "title")


@query(
    "J4",
    with_todo("SELECT username FROM users WHERE id IN (SELECT user_id FROM lists WHERE color = '#FF0000')"),
)
def j4_users_with_lists(t: Tables) -> DataFrame:
    red = roles.lists(t).where(F.col("color") == "#FF0000")
    return relational.with_match(roles.users(t), red, "id", "user_id", unique=True).select("username")


@query(
    "J5",
    with_todo("""
SELECT id, title FROM lists l
WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.list_id = l.id AND i.deleted_at IS NULL)"""),
)
def j5_lists_without_items(t: Tables) -> DataFrame:
    live = relational.active(roles.items(t))
    return relational.without_match(roles.lists(t), live, "id", "list_id", unique=True).select("id", "title")


@query(
    "J6",
    with_todo("""
, counts AS (SELECT user_id, count(*) AS list_count FROM lists WHERE color IS NOT NULL GROUP BY user_id)
SELECT u.username, coalesce(c.list_count, 0) AS list_count
FROM users u LEFT JOIN counts c ON c.user_id = u.id ORDER BY u.username"""),
)
def j6_list_counts_with_default(t: Tables) -> DataFrame:
    colored = roles.lists(t).where(F.col("color").isNotNull())
    counted = relational.count_per_parent(roles.users(t), colored, "id", "user_id", {"list_count": None})
    return counted.select("username", "list_count").orderBy("username")


@query(
    "J7",
    """
SELECT n_name, (SELECT count(*) FROM customer c WHERE c.c_nationkey = n.n_nationkey) AS customers,
       (SELECT count(*) FROM supplier s WHERE s.s_nationkey = n.n_nationkey) AS suppliers
FROM nation n""",
)
def j7_counts_by_subquery(t: Tables) -> DataFrame:
    nations = t.nation.select("n_nationkey", "n_name")
    customers = relational.count_per_parent(nations, t.customer, "n_nationkey", "c_nationkey", {"customers": None})
    both = relational.count_per_parent(customers, t.supplier, "n_nationkey", "s_nationkey", {"suppliers": None})
    return both.select("n_name", "customers", "suppliers")


TREE_SQL = "tree AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey > 0 THEN c_custkey // 8 END AS manager FROM customer)"


def _tree(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    return t.customer.select(
        key.alias("id"), F.col("c_name").alias("name"), F.when(key > 0, F.floor(key / 8)).alias("manager")
    )


@query(
    "J13",
    f"WITH {TREE_SQL} SELECT a.id, a.name, b.name AS manager_name FROM tree a LEFT JOIN tree b ON b.id = a.manager",
)
def j13_manager_of_employee(t: Tables) -> DataFrame:
    named = relational.with_parent(_tree(t), "id", "manager", {"name": "manager_name"})
    return named.select("id", "name", "manager_name")


@query(
    "U3 J13",
    f"""
WITH RECURSIVE {TREE_SQL},
walk AS (
  SELECT id, id AS root, CAST(0 AS BIGINT) AS depth FROM tree WHERE manager IS NULL
  UNION ALL
  SELECT t.id, w.root, w.depth + 1 FROM tree t JOIN walk w ON t.manager = w.id)
SELECT id, root, depth FROM walk""",
)
def u3_hierarchy_closure(t: Tables) -> DataFrame:
    return hierarchy.roots_and_depths(_tree(t), "id", "manager")


FOREST_SQL = f"""
WITH RECURSIVE {TREE_SQL},
walk AS (
  SELECT id, id AS root, CAST(0 AS BIGINT) AS depth, [id] AS path FROM tree WHERE manager IS NULL
  UNION ALL
  SELECT t.id, w.root, w.depth + 1, list_append(w.path, t.id) FROM tree t JOIN walk w ON t.manager = w.id)
"""


@query(
    "U3",
    FOREST_SQL
    + """
SELECT id, root, depth, first, first + size - 1 AS last
FROM (SELECT id, root, depth, row_number() OVER (ORDER BY path) - 1 AS first FROM walk)
JOIN (SELECT above AS id, count(*) AS size FROM (SELECT unnest(path) AS above FROM walk) GROUP BY above) USING (id)""",
)
def u3_subtree_ranges(t: Tables) -> DataFrame:
    return hierarchy.subtree_ranges(_tree(t), "id", "manager")


@query(
    "U3",
    FOREST_SQL
    + """
SELECT above AS ancestor, id, depth - (len_above - 1) AS distance
FROM (SELECT id, depth, unnest(path) AS above, generate_subscripts(path, 1) AS len_above FROM walk)
WHERE above % 20 = 0 AND above <> id""",
)
def u3_descendants(t: Tables) -> DataFrame:
    """Everyone below every twentieth manager."""
    ranges = hierarchy.subtree_ranges(_tree(t), "id", "manager")
    return hierarchy.descendants(ranges, "id", t.customer.where("c_custkey % 20 = 0").select("c_custkey"))


# --- aggregation -----------------------------------------------------------------------------------------------------

COUNTS_SQL = """
SELECT l.id, l.user_id, l.title, {total} AS total_items,
       count(i.list_id) FILTER (WHERE i.deleted_at IS NULL AND i.is_completed) AS completed_items,
       count(i.list_id) FILTER (WHERE i.deleted_at IS NULL AND NOT i.is_completed) AS pending_items
FROM lists l LEFT JOIN items i ON i.list_id = l.id
WHERE l.deleted_at IS NULL GROUP BY l.id, l.user_id, l.title"""
_COUNT_COLUMNS = ["id", "user_id", "title", "total_items", "completed_items", "pending_items"]


@query("A1 J2", with_todo(COUNTS_SQL.format(total="count(i.list_id) FILTER (WHERE i.deleted_at IS NULL)")))
def a1_list_item_counts(t: Tables) -> DataFrame:
    return relational.lists_with_counts(roles.lists(t), roles.items(t)).select(*_COUNT_COLUMNS)


@query("A2", with_todo(COUNTS_SQL.format(total="CAST(sum(CASE WHEN i.deleted_at IS NULL THEN 1 ELSE 0 END) AS BIGINT)")))
def a2_list_item_counts_padded(t: Tables) -> DataFrame:
    return relational.lists_with_counts(roles.lists(t), roles.items(t), padded=True).select(*_COUNT_COLUMNS)


@query("A3", "SELECT count(*) AS order_count, max(o_totalprice) AS highest FROM orders")
def a3_count_and_max(t: Tables) -> DataFrame:
    return t.orders.agg(F.count(F.lit(1)).alias("order_count"), F.max("o_totalprice").alias("highest"))


@query(
    "A4",
    with_todo("""
SELECT u.username, count(l.id) AS list_count FROM users u LEFT JOIN lists l ON l.user_id = u.id AND l.deleted_at IS NULL
GROUP BY u.username ORDER BY u.username"""),
)
def a4_lists_per_user(t: Tables) -> DataFrame:
    live = relational.active(roles.lists(t))
    counted = relational.count_per_parent(roles.users(t), live, "id", "user_id", {"list_count": None})
    return counted.select("username", "list_count").orderBy("username")


@query("A5", "SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def a5_repeated_texts(t: Tables) -> DataFrame:
    return relational.duplicated(t.documents, ["text"])


@query(
    "A6",
    "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY l_suppkey",
)
def a6_distinct_counts(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(
        F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_orderkey").alias("orders")
    )


@query(
    "A7",
    "SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ', ' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY c_nationkey",
)
def a7_segments_per_nation(t: Tables) -> DataFrame:
    return relational.joined_text(t.customer, ["c_nationkey"], "c_mktsegment", ", ", "segments")


@query(
    "A8",
    """
WITH pairs AS (
  SELECT DISTINCT l_suppkey, CAST(substr(p_brand, 7) AS INTEGER) AS position, p_brand
  FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT l_suppkey, string_agg(p_brand, ',' ORDER BY position) AS brands FROM pairs GROUP BY l_suppkey""",
)
def a8_ordered_brands_per_supplier(t: Tables) -> DataFrame:
    brand = t.part.select("p_partkey", "p_brand", F.substr("p_brand", F.lit(7)).cast("int").alias("position"))
    used = t.lineitem.select("l_suppkey", "l_partkey").distinct()
    pairs = used.join(brand, F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "position", "p_brand").distinct()
    ordered = relational.ordered_array(pairs, ["l_suppkey"], "position", "p_brand", "brands")
    return ordered.select("l_suppkey", F.array_join("brands", ",").alias("brands"))


@query(
    "A9",
    "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS events FROM events GROUP BY user_id",
)
def a9_event_set_per_user(t: Tables) -> DataFrame:
    sets = relational.value_set(t.events, ["user_id"], "event_type", "events")
    return sets.select("user_id", F.array_join("events", ",").alias("events"))


@query(
    "A10",
    with_todo(
        "SELECT user_id, coalesce(max(position), -1) + 1 AS next_position FROM lists WHERE deleted_at IS NULL GROUP BY user_id"
    ),
)
def a10_next_position(t: Tables) -> DataFrame:
    return relational.next_position(roles.lists(t), "user_id")


TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@query("A14", " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS \"count\" FROM {n}" for n in TABLES))
def a14_table_counts(t: Tables) -> DataFrame:
    return relational.table_counts({name: getattr(t, name) for name in TABLES})


# --- window, sort, limit ---------------------------------------------------------------------------------------------


@query("W5", with_todo("SELECT id, title, row_number() OVER (ORDER BY created_at, id) AS row_num FROM lists"))
def w5_row_number_overall(t: Tables) -> DataFrame:
    return ranking.number_rows(roles.lists(t), ["created_at", "id"]).select("id", "title", "row_num")


@query(
    "W5",
    with_todo("""
SELECT id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS row_num FROM lists"""),
)
def w5_row_number_per_user(t: Tables) -> DataFrame:
    numbered = ranking.number_rows(roles.lists(t), ["created_at", "id"], within=["user_id"], descending=True)
    return numbered.select("id", "user_id", "row_num")


@query("O1", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def o1_top_orders(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_totalprice")
    return ranking.top_n(rows, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 20)


@query("O2", with_todo("SELECT id, color FROM lists ORDER BY color ASC NULLS LAST"))
def o2_sort_ascending(t: Tables) -> DataFrame:
    return ranking.sort_by(roles.lists(t).select("id", "color"), "color")


@query("O2", with_todo("SELECT id, color, position FROM lists ORDER BY color DESC NULLS FIRST, id"))
def o2_sort_descending(t: Tables) -> DataFrame:
    return ranking.sort_by(roles.lists(t).select("id", "color", "position"), "color", descending=True)


@query("O3", with_todo("SELECT id, title FROM lists ORDER BY created_at, id LIMIT 25 OFFSET 100"))
def o3_page_of_lists(t: Tables) -> DataFrame:
    return ranking.page(roles.lists(t), ["created_at", "id"], 100, 25).select("id", "title")


@query(
    "O3",
    """
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 40 OFFSET (SELECT count(*) * 2 // 3 FROM lineitem)""",
)
def o3_deep_page(t: Tables) -> DataFrame:
    """A page behind two thirds of all rows."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return ranking.page(rows, order, rows.count() * 2 // 3, 40).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query(
    "O3",
    """
WITH numbered AS (
  SELECT l_orderkey, l_linenumber, l_extendedprice, count(*) OVER () AS n,
         row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place FROM lineitem)
SELECT CASE WHEN place <= 40 THEN 'first' WHEN place <= n // 2 + 40 THEN 'middle' ELSE 'next' END AS page, l_orderkey, l_linenumber, l_extendedprice
FROM numbered WHERE place <= 40 OR place BETWEEN n // 2 + 1 AND n // 2 + 80""",
)
def o3_kept_pages(t: Tables) -> DataFrame:
    """Pages of a kept order: the first, one in the middle, and the one after that."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    order = kept.keep_order(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], scratch_path(t.spark, "order"))
    middle = order.rows // 2
    pages = {"first": order.page(0, 40), "middle": order.page(middle, 40), "next": order.page(middle + 40, 40)}
    picked = ["l_orderkey", "l_linenumber", "l_extendedprice"]
    return reduce(DataFrame.unionByName, [page.select(F.lit(name).alias("page"), *picked) for name, page in pages.items()])


@query("O4", "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC NULLS FIRST")
def o4_auto_sorted(t: Tables) -> DataFrame:
    return ranking.auto_sort(t.events.select("event_id", "ts", "event_type"))


@query("O5", "SELECT * FROM events ORDER BY event_id DESC LIMIT 100")
def o5_newest_table_rows(t: Tables) -> DataFrame:
    return ranking.top_n(t.events, [F.col("event_id").desc()], 100)


# --- set operations --------------------------------------------------------------------------------------------------


@query("U1", with_todo("SELECT 'user' AS type, username AS name FROM users UNION ALL SELECT 'list' AS type, title AS name FROM lists"))
def u1_tagged_union(t: Tables) -> DataFrame:
    users = roles.users(t).select(F.col("username").alias("name"))
    lists = roles.lists(t).select(F.col("title").alias("name"))
    return relational.tagged_union({"user": users, "list": lists})


@query("U2", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def u2_distinct(t: Tables) -> DataFrame:
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


# --- functions -------------------------------------------------------------------------------------------------------


@query(
    "F1 F7",
    with_todo("""
SELECT id, title, CASE WHEN color IS NULL THEN 'plain' ELSE 'colored' END AS look,
       CASE position % 5 WHEN 0 THEN 'None' WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' WHEN 3 THEN 'High' ELSE 'Unknown' END
         AS priority_label
FROM lists"""),
)
def f1_case_labels(t: Tables) -> DataFrame:
    look = F.when(F.col("color").isNull(), "plain").otherwise("colored")
    label = scalar.priority_label(F.col("position") % 5)
    return roles.lists(t).select("id", "title", look.alias("look"), label.alias("priority_label"))


@query(
    "F2",
    with_todo("""
SELECT id, coalesce(display_name, username) AS shown, CASE WHEN deleted_at IS NULL THEN 'active' ELSE 'deleted' END AS state
FROM users"""),
)
def f2_coalesce(t: Tables) -> DataFrame:
    state = F.expr("if(deleted_at IS NULL, 'active', 'deleted')")
    shown = scalar.first_present(F.col("display_name"), F.col("username"))
    return roles.users(t).select("id", shown.alias("shown"), state.alias("state"))


@query(
    "F3",
    with_todo("""
SELECT id, upper(username) AS upper_name, length(email) AS email_length, length(rtrim(username || '  ')) AS trimmed_length,
       username || ' <' || email || '>' AS contact
FROM users"""),
)
def f3_string_functions(t: Tables) -> DataFrame:
    return roles.users(t).select(
        "id",
        F.upper("username").alias("upper_name"),
        F.length("email").alias("email_length"),
        scalar.trimmed_length(F.concat("username", F.lit("  "))).alias("trimmed_length"),
        F.concat("username", F.lit(" <"), "email", F.lit(">")).alias("contact"),
    )


@query(
    "F4",
    """
SELECT event_id, date_diff('day', CAST(ts AS DATE), DATE '2024-02-01') AS days_since
FROM events""",
)
def f4_day_difference(t: Tables) -> DataFrame:
    return t.events.select("event_id", scalar.day_difference(roles.as_of(), F.col("ts")).alias("days_since"))


@query(
    "F5 F6",
    with_todo("""
SELECT l.id, u.email,
       coalesce(strpos(u.email, '@') > 0 AND strpos(substr(u.email, strpos(u.email, '@')), '.') > 0, false) AS valid_email,
       coalesce(regexp_matches(l.color, '^#[0-9A-Fa-f]{6}$'), true) AS valid_color
FROM lists l JOIN users u ON u.id = l.user_id"""),
)
def f5_email_and_color_checks(t: Tables) -> DataFrame:
    users = roles.users(t).select(F.col("id").alias("user_id"), "email")
    return roles.lists(t).join(users, "user_id").select(
        "id",
        "email",
        scalar.is_email(F.col("email")).alias("valid_email"),
        scalar.is_hex_color(F.col("color")).alias("valid_color"),
    )


@query("F8", "SELECT doc_id, sha256(text) AS checksum FROM documents")
def f8_content_hash(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", scalar.content_hash(F.col("text")).alias("checksum"))


@query(
    "F9",
    """
SELECT c_custkey, CASE WHEN c_name <> '' AND c_mktsegment <> '' THEN
         sha256(c_name || chr(0) || c_mktsegment || chr(0) || c_nationkey || chr(0) || 'os') END AS identity_hash
FROM customer""",
)
def f9_identity_hash(t: Tables) -> DataFrame:
    fields = [F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey").cast("string"), F.lit("os")]
    return t.customer.select("c_custkey", scalar.identity_hash(*fields).alias("identity_hash"))


@query(
    "F12",
    r"""
SELECT doc_id, replace(text, '''', '''''') AS escaped, '''' || replace(source, '''', '''''') || '''' AS quoted,
       CASE WHEN doc_id % 2 = 0 THEN 'NULL' ELSE '''' || doc_id || '''' END AS quoted_id
FROM documents""",
)
def f12_sql_quoting(t: Tables) -> DataFrame:
    odd = F.when(F.col("doc_id") % 2 != 0, F.col("doc_id"))
    return t.documents.select(
        "doc_id",
        scalar.sql_escape(F.col("text")).alias("escaped"),
        scalar.sql_quote(F.col("source")).alias("quoted"),
        scalar.sql_quote(odd).alias("quoted_id"),
    )


@query(
    "F13",
    """
SELECT o_orderkey, CASE WHEN length(CAST(o_orderkey AS VARCHAR)) >= 4 THEN CAST(o_orderkey AS VARCHAR)
         ELSE lpad(CAST(o_orderkey AS VARCHAR), 4, '0') END AS padded, strftime(o_orderdate, '%Y-%m-%d') AS order_day
FROM orders""",
)
def f13_pad_and_date(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey",
        scalar.pad_id(F.col("o_orderkey"), 4).alias("padded"),
        scalar.iso_date(F.col("o_orderdate")).alias("order_day"),
    )


@query(
    "F14",
    """
SELECT o_orderkey, CASE WHEN n >= 1000000 THEN printf('%.1fM', (n + CAST(n % 1000000 = 250000 AS BIGINT)) / 1000000.0)
         WHEN n >= 1000 THEN printf('%.1fK', (n + CAST(n % 1000 = 250 AS BIGINT)) / 1000.0) ELSE CAST(n AS VARCHAR) END AS compact
FROM (SELECT o_orderkey, CAST(o_orderkey AS BIGINT) * 337 AS n FROM orders)""",
)
def f14_compact_numbers(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", scalar.compact_number(F.col("o_orderkey") * 337).alias("compact"))


@query(
    "F15",
    """
SELECT l_orderkey, l_linenumber, l_quantity,
       CAST(floor(l_quantity * CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 1024 WHEN 3 THEN 1048576 WHEN 4 THEN 1073741824
            WHEN 5 THEN 1 END) AS BIGINT) AS bytes
FROM lineitem""",
)
def f15_size_text(t: Tables) -> DataFrame:
    unit = scalar.label_of(F.col("l_linenumber"), {1: "b", 2: "KB", 3: " mb", 4: "Gb", 5: ""}, "pb")
    text = F.concat(F.col("l_quantity").cast("string"), unit)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", scalar.size_bytes(text).alias("bytes"))


@query(
    "F16",
    with_todo("""
SELECT id, '{"id":' || id || ',"username":"' || username || '","display_name":'
           || coalesce('"' || display_name || '"', 'null') || '}' AS row_json
FROM users"""),
)
def f16_row_to_json(t: Tables) -> DataFrame:
    rows = roles.users(t).select("id", "username", "display_name")
    return rows.select("id", scalar.row_json(rows).alias("row_json"))


@query("F17", "SELECT count(*) AS rows_seen, count(*) AS ids, count(*) AS well_formed, 1 AS times, true AS just_now FROM customer")
def f17_uuid_and_now(t: Tables) -> DataFrame:
    """Facts of new ids and times: all ids differ and have their form, all rows have one time, which is now."""
    made = materialize(t.customer.select(scalar.new_uuid().alias("id"), scalar.iso_now().alias("at")), "made")
    age = F.unix_timestamp() - F.unix_timestamp(F.to_timestamp(F.min("at")))
    return made.agg(
        F.count(F.lit(1)).alias("rows_seen"),
        F.count_distinct("id").alias("ids"),
        F.count_if(F.col("id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")).alias("well_formed"),
        F.count_distinct("at").cast("int").alias("times"),
        age.between(0, 3600).alias("just_now"),
    )
