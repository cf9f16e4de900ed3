"""Script corpus: discovery, path rules, manifests and names, over documents, parts and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions import naming
from ledgerlake.operators import corpus
from ledgerlake.plans import roles
from ledgerlake.plans.registry import Tables, query
from ledgerlake.plans.roles import with_corpus, with_ledger


@query(
    "S4 F8",
    with_corpus(
        "SELECT doc_id, path, sha256(content) AS checksum FROM corpus "
        "WHERE ends_with(path, '.sql') OR ends_with(path, '.sql.tmpl') ORDER BY path"
    ),
)
def s4_script_corpus(t: Tables) -> DataFrame:
    return corpus.scripts(corpus.fingerprinted(roles.corpus(t)).select("doc_id", "path", "checksum"))


INCLUDE, EXCLUDE = ("src1", "src2", "src3/en"), ("src2/fr", "src1/de")


def _under_sql(prefixes) -> str:
    return "(" + " OR ".join(f"path = '{p}' OR starts_with(path, '{p}/')" for p in prefixes) + ")"


@query("P6", with_corpus(f"SELECT doc_id, path FROM corpus WHERE {_under_sql(INCLUDE)} AND NOT {_under_sql(EXCLUDE)}"))
def p6_filter_paths(t: Tables) -> DataFrame:
    return corpus.filter_paths(roles.corpus(t), INCLUDE, EXCLUDE).select("doc_id", "path")


RULES_SQL = """
, moves AS (
  SELECT event_id, 'src' || (user_id % 20) || '/' || CASE user_id % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'en' WHEN 2 THEN 'es' ELSE 'fr' END
           AS prefix, CASE WHEN event_type IN ('click', 'signup') THEN 'include' ELSE 'exclude' END AS action
  FROM events WHERE event_type <> 'view')
, rules AS (SELECT prefix, arg_max(action, event_id) AS action FROM moves GROUP BY prefix)"""


def _rules(t: Tables) -> DataFrame:
    """One rule per event: it includes or excludes a folder."""
    language = F.element_at(F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")]), (F.col("user_id") % 4 + 1).cast("int"))
    folder = F.array(F.concat(F.lit("src"), F.col("user_id") % 20, F.lit("/"), language))
    included = F.col("event_type").isin("click", "signup")
    none = F.array().cast("array<string>")
    return t.events.where(F.col("event_type") != "view").select(
        F.col("event_id").alias("seq"),
        F.when(included, folder).otherwise(none).alias("include"),
        F.when(included, none).otherwise(folder).alias("exclude"),
    )


@query("P10", with_corpus(RULES_SQL + "SELECT prefix, action FROM rules"))
def p10_evaluate_rules(t: Tables) -> DataFrame:
    return corpus.evaluate_rules(_rules(t))


@query(
    "P6 P10",
    with_corpus(
        RULES_SQL
        + """
SELECT c.doc_id, c.path FROM corpus c
WHERE EXISTS (SELECT 1 FROM rules r WHERE r.action = 'include' AND starts_with(c.path, r.prefix || '/'))
  AND NOT EXISTS (SELECT 1 FROM rules r WHERE r.action = 'exclude' AND starts_with(c.path, r.prefix || '/'))"""
    ),
)
def p10_filter_by_rules(t: Tables) -> DataFrame:
    files = roles.corpus(t).select("doc_id", "path")
    return corpus.filter_paths_by_rules(files, corpus.evaluate_rules(_rules(t)))


MATCHED_SQL = RULES_SQL.replace("WHERE event_type <> 'view')", "WHERE event_type <> 'view' AND user_id % 3 <> 2 AND event_id % 5 <> 0)")


@query(
    "P10 P6",
    with_corpus(
        MATCHED_SQL
        + """
, base AS (SELECT 'src' || n_nationkey AS prefix, CASE WHEN n_nationkey % 4 = 3 THEN 'exclude' ELSE 'include' END AS action FROM nation WHERE n_nationkey < 12
  UNION ALL SELECT 'src1/de', 'exclude')
, merged AS (SELECT * FROM rules UNION ALL SELECT * FROM base WHERE prefix NOT IN (SELECT prefix FROM rules))
SELECT c.doc_id, c.path FROM corpus c
WHERE EXISTS (SELECT 1 FROM merged r WHERE r.action = 'include' AND starts_with(c.path, r.prefix || '/'))
  AND NOT EXISTS (SELECT 1 FROM merged r WHERE r.action = 'exclude' AND starts_with(c.path, r.prefix || '/'))"""
    ),
)
def p10_effective_paths(t: Tables) -> DataFrame:
    """Rules from end to end: those that match, in order, over base lists, down to the paths that stay."""
    conditions = {
        "match_type": F.when(F.col("user_id") % 3 == 1, "local").when(F.col("user_id") % 3 == 2, "remote"),
        "match_test": F.when(F.col("event_id") % 5 == 0, False).when(F.col("event_id") % 5 == 1, True),
    }
    facts = t.events.select(F.col("event_id").alias("seq"), *[test.alias(name) for name, test in conditions.items()])
    rules = _rules(t).join(facts, "seq")
    action = F.when(F.col("n_nationkey") % 4 == 3, "exclude").otherwise("include")
    base = t.nation.where("n_nationkey < 12").select(F.concat(F.lit("src"), "n_nationkey").alias("prefix"), action.alias("action"))
    base = base.unionByName(t.nation.where("n_nationkey = 0").select(F.lit("src1/de").alias("prefix"), F.lit("exclude").alias("action")))
    files = roles.corpus(t).select("doc_id", "path")
    return corpus.effective_paths(files, rules, {"type": "local", "test": True}, base)


CHANGE_FILES_SQL = """
WITH files AS (
  SELECT 'changes/' || CASE o_orderkey % 7 WHEN 0 THEN 'loose' ELSE strftime(o_orderdate, '%Y-%m-%d') || '-' || lower(o_orderstatus) END || '/' ||
         CASE WHEN o_orderkey % 11 = 0 THEN 'changelog.md' WHEN o_orderkey % 3 = 0 THEN 'revert/' || o_orderkey || '_x.sql'
              WHEN o_orderkey % 5 = 0 THEN 'notes/' || o_orderkey || '.sql' WHEN o_orderkey % 5 = 1 THEN 'change/readme.md' ELSE 'change/' || o_orderkey || '_y.sql.tmpl' END AS path
  FROM orders)
, named AS (SELECT split_part(path, '/', 2) AS name, split_part(path, '/', 3) AS place, split_part(path, '/', 4) AS file FROM files)
SELECT name, CASE WHEN name <> 'loose' THEN CAST(left(name, 10) AS DATE) END AS date, CASE WHEN name <> 'loose' THEN substr(name, 12) ELSE name END AS description,
       count(*) FILTER (WHERE place = 'change' AND file <> 'readme.md') AS change_files, count(*) FILTER (WHERE place = 'revert') AS revert_files,
       count(*) FILTER (WHERE place = 'revert') > 0 AS has_revert, bool_or(place = 'changelog.md') AS has_changelog,
       count(*) FILTER (WHERE place = 'revert' OR place = 'change' AND file <> 'readme.md') > 0 AS valid,
       CASE WHEN count(*) FILTER (WHERE place = 'revert' OR place = 'change' AND file <> 'readme.md') = 0
            THEN 'Must have at least change/ or revert/ folder with files' END AS error
FROM named GROUP BY name"""


@query("J10", CHANGE_FILES_SQL)
def j10_discover_changes(t: Tables) -> DataFrame:
    """Changes found in a tree of files: names with and without a date, reverts, changelogs, folders without scripts."""
    key = F.col("o_orderkey")
    name = F.when(key % 7 == 0, "loose").otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("-"), F.lower("o_orderstatus")))
    file = (
        F.when(key % 11 == 0, "changelog.md")
        .when(key % 3 == 0, F.concat(F.lit("revert/"), key, F.lit("_x.sql")))
        .when(key % 5 == 0, F.concat(F.lit("notes/"), key, F.lit(".sql")))
        .when(key % 5 == 1, "change/readme.md")
        .otherwise(F.concat(F.lit("change/"), key, F.lit("_y.sql.tmpl")))
    )
    return corpus.discover_changes(t.orders.select(F.concat(F.lit("changes/"), name, F.lit("/"), file).alias("path")))


MANIFESTS_SQL = """
, manifests AS (
  SELECT page_id AS manifest, CASE WHEN page_id % 10 = 0 THEN chr(10) || '# nothing yet' || chr(10)
    ELSE '# files of ' || page_id || chr(10) || '  sql/seeds/t_' || page_id || '.sql  ' || chr(10) || chr(10)
         || 'sql/tables/t_' || (page_id * 3) || '.sql' || chr(10) END AS content
  FROM pages)
, listed AS (
  SELECT manifest, trim(line) AS path FROM (SELECT manifest, unnest(string_split(content, chr(10))) AS line FROM manifests)
  WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#'))"""


def _manifests(t: Tables) -> DataFrame:
    page = F.col("page_id")
    text = F.concat(
        F.lit("# files of "), page, F.lit("\n  sql/seeds/t_"), page, F.lit(".sql  \n\nsql/tables/t_"), page * 3, F.lit(".sql\n")
    )
    return t.pages.select(
        page.alias("manifest"), F.when(page % 10 == 0, "\n# nothing yet\n").otherwise(text).alias("content")
    )


@query("S5", with_ledger(MANIFESTS_SQL + "SELECT manifest, path FROM listed ORDER BY manifest, path"))
def s5_manifest_paths(t: Tables) -> DataFrame:
    return corpus.manifest_paths(_manifests(t))


@query(
    "S5",
    with_ledger(
        MANIFESTS_SQL
        + """
SELECT manifest, NULL AS path, 'empty' AS error FROM manifests WHERE manifest NOT IN (SELECT manifest FROM listed)
UNION ALL
SELECT manifest, path, 'missing' FROM listed WHERE path NOT IN (SELECT filepath FROM disk_files)"""
    ),
)
def s5_manifest_errors(t: Tables) -> DataFrame:
    files = roles.disk_files(t).select(F.col("filepath").alias("path"))
    return corpus.manifest_errors(_manifests(t), files)


@query(
    "F10",
    """
WITH names AS (
  SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'init-' || o_orderkey
           WHEN o_orderpriority = '2-HIGH' THEN '2024-02-31-bad-' || o_orderkey
           ELSE strftime(o_orderdate, '%Y-%m-%d') || '-add-' || o_orderkey END AS name FROM orders)
SELECT o_orderkey, name, CAST(try_cast(nullif(regexp_extract(name, '^(\\d{4}-\\d{2}-\\d{2})-(.+)$', 1), '') AS DATE) AS VARCHAR) AS change_date,
       CASE WHEN try_cast(nullif(regexp_extract(name, '^(\\d{4}-\\d{2}-\\d{2})-(.+)$', 1), '') AS DATE) IS NOT NULL
            THEN regexp_extract(name, '^(\\d{4}-\\d{2}-\\d{2})-(.+)$', 2) ELSE name END AS description
FROM names""".replace("\\\\", "\\"),
)
def f10_change_names(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    name = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("init-"), key))
        .when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit("2024-02-31-bad-"), key))
        .otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("-add-"), key))
    )
    parsed = corpus.parsed_names(t.orders.select("o_orderkey", name.alias("name")))
    return parsed.withColumn("change_date", F.col("change_date").cast("string"))


FILES_SQL = r"""
WITH files AS (
  SELECT p_partkey, p_brand, CASE WHEN p_size < 25 THEN lpad(CAST(p_size AS VARCHAR), 3, '0') || '_' ELSE '' END || replace(p_name, ' ', '-')
           || CASE p_type WHEN 'PROMO' THEN '.sql.tmpl' WHEN 'SMALL' THEN '.txt' ELSE '.sql' END AS filename FROM part)
"""


def _files(t: Tables) -> DataFrame:
    sequence = F.when(F.col("p_size") < 25, F.concat(F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit("_"))).otherwise("")
    suffix = F.when(F.col("p_type") == "PROMO", ".sql.tmpl").when(F.col("p_type") == "SMALL", ".txt").otherwise(".sql")
    return t.part.select(
        "p_partkey", "p_brand", F.concat(sequence, F.replace("p_name", F.lit(" "), F.lit("-")), suffix).alias("filename")
    )


@query(
    "F10",
    FILES_SQL
    + r"""
SELECT p_partkey, filename, TRY_CAST(nullif(regexp_extract(filename, '^(\d{3})_(.+)$', 1), '') AS INTEGER) AS sequence,
       regexp_replace(regexp_replace(filename, '(\.sql\.tmpl|\.sql|\.txt)$', ''), '^\d{3}_(.+)$', '\1') AS description
FROM files""",
)
def f10_file_names(t: Tables) -> DataFrame:
    return _files(t).select(
        "p_partkey",
        "filename",
        naming.file_sequence(F.col("filename")).alias("sequence"),
        naming.file_description(F.col("filename")).alias("description"),
    )


@query(
    "F10 A5",
    FILES_SQL
    + r"""
SELECT p_brand, CAST(left(filename, 3) AS INTEGER) AS sequence, count(*) AS n FROM files
WHERE regexp_matches(filename, '^\d{3}_.+$') GROUP BY ALL HAVING count(*) > 1""",
)
def f10_duplicate_sequences(t: Tables) -> DataFrame:
    return corpus.duplicate_sequences(_files(t), ["p_brand"])


KEYS_SQL = r"""
WITH files AS (
  SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN upper(replace(c_name, '#', '_')) WHEN 'BUILDING' THEN replace(c_name, '#', '-')
           ELSE lower(c_mktsegment) || '.seed_' || c_nationkey END || '.json' AS filename FROM customer)
, keyed AS (
  SELECT filename, CASE WHEN filename LIKE 'C%' THEN 'customer' || regexp_extract(filename, '\d+')
           ELSE regexp_extract(filename, '^[a-z]+') || 'Seed' || regexp_extract(filename, '\d+') END AS context_key FROM files)
"""


def _data_files(t: Tables) -> DataFrame:
    segment = F.col("c_mktsegment")
    stem = (
        F.when(segment == "MACHINERY", F.upper(F.replace("c_name", F.lit("#"), F.lit("_"))))
        .when(segment == "BUILDING", F.replace("c_name", F.lit("#"), F.lit("-")))
        .otherwise(F.concat(F.lower(segment), F.lit(".seed_"), "c_nationkey"))
    )
    return t.customer.select(F.concat(stem, F.lit(".json")).alias("filename"))


@query("F11", KEYS_SQL + "SELECT filename, context_key FROM keyed")
def f11_context_keys(t: Tables) -> DataFrame:
    return _data_files(t).select("filename", naming.context_key(F.col("filename")).alias("context_key"))


@query(
    "F11 A5",
    """
WITH files AS (SELECT DISTINCT p_name || '.json' AS filename FROM part UNION SELECT DISTINCT replace(p_name, ' ', '_') || '.yml' FROM part)
SELECT regexp_extract(filename, '^[a-z]+') || upper(regexp_extract(filename, '[ _]([a-z])', 1)) || regexp_extract(filename, '[ _][a-z]([a-z]*)', 1)
         AS context_key, count(*) AS files
FROM files GROUP BY 1 HAVING count(*) > 1""",
)
def f11_key_collisions(t: Tables) -> DataFrame:
    names = t.part.select(F.concat("p_name", F.lit(".json")).alias("filename")).unionByName(
        t.part.select(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".yml")).alias("filename"))
    )
    return corpus.key_collisions(names)
