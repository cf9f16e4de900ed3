"""SQL functions, table functions and procedures as session objects.

A procedure is one SQL script: variables, conditions, loops and handlers run in Spark's own scripting, with the arguments as named parameters.
Parquet tables take no UPDATE, so tables that procedures write to are kept as changes: a row's newest change is its state, and an update
or a delete is one more change.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCALAR_FUNCTIONS = {
    "is_valid_email": (
        "(email STRING) RETURNS BOOLEAN RETURN "
        "coalesce(instr(email, '@') > 0 AND locate('.', email, instr(email, '@')) > 0, false)"
    ),
    "is_valid_hex_color": (
        "(color STRING) RETURNS BOOLEAN RETURN coalesce(regexp_like(color, '^#[0-9A-Fa-f]{6}$'), true)"
    ),
    "priority_label": (
        "(priority INT) RETURNS STRING RETURN "
        "CASE priority WHEN 0 THEN 'None' WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' WHEN 3 THEN 'High' ELSE 'Unknown' END"
    ),
}
# Over the views ``users`` and ``todo_lists``.
TABLE_FUNCTIONS = {
    "user_by_id": (
        "(p_id BIGINT) RETURNS TABLE (id BIGINT, email STRING, username STRING) "
        "RETURN SELECT id, email, username FROM users WHERE id = p_id AND deleted_at IS NULL"
    ),
    "lists_of_user": (
        "(p_user BIGINT) RETURNS TABLE (id BIGINT, title STRING, position INT) "
        "RETURN SELECT id, title, position FROM todo_lists WHERE user_id = p_user AND deleted_at IS NULL"
    ),
}
PROCEDURES = {
    "users_of_nation": "SELECT id, username FROM users WHERE nation_id = :nation AND deleted_at IS NULL",
    # over the changed table ``todo_lists`` (see ``changed_table``) and the view ``users``
    "create_todo_list": """
BEGIN
  DECLARE place INT;
  IF NOT EXISTS (SELECT 1 FROM users WHERE id = :user AND deleted_at IS NULL) THEN
    SELECT raise_error(concat('no active user ', :user));
  END IF;
  IF EXISTS (SELECT 1 FROM todo_lists WHERE id = :id) THEN
    SELECT raise_error(concat('there is a list ', :id));
  END IF;
  SET place = (SELECT coalesce(max(position), -1) + 1 FROM todo_lists WHERE user_id = :user AND deleted_at IS NULL);
  INSERT INTO {todo_lists} (id, user_id, title, color, position, updated_at, deleted_at, change_no)
    VALUES (:id, :user, :title, :color, place, :as_of, NULL, 0);
  SELECT :id AS id, place AS position;
END""",
    "get_todo_lists_by_user": "SELECT id, title, color, position, updated_at FROM todo_lists WHERE user_id = :user AND deleted_at IS NULL ORDER BY position, id",
    "update_todo_list": """
BEGIN
  DECLARE hits BIGINT;
  SET hits = (SELECT count(*) FROM todo_lists WHERE id = :id AND deleted_at IS NULL);
  IF hits > 0 THEN
    INSERT INTO {todo_lists} (id, user_id, title, color, position, updated_at, deleted_at, change_no)
      SELECT id, user_id, coalesce(:title, title), coalesce(:color, color), position, :as_of, deleted_at, change_no + 1
      FROM todo_lists WHERE id = :id AND deleted_at IS NULL;
  END IF;
  SELECT hits > 0 AS success;
END""",
    "delete_todo_list": """
BEGIN
  DECLARE hits BIGINT;
  SET hits = (SELECT count(*) FROM todo_lists WHERE id = :id AND deleted_at IS NULL);
  IF hits > 0 THEN
    INSERT INTO {todo_lists} (id, user_id, title, color, position, updated_at, deleted_at, change_no)
      SELECT id, user_id, title, color, position, updated_at, :as_of, change_no + 1 FROM todo_lists WHERE id = :id AND deleted_at IS NULL;
  END IF;
  SELECT hits > 0 AS success;
END""",
    # over the view ``incoming`` (id, user_id, title, color); a row that cannot be made stops the script, and the handler tells so
    "import_todo_lists": """
BEGIN
  DECLARE made BIGINT DEFAULT 0;
  DECLARE EXIT HANDLER FOR SQLEXCEPTION BEGIN
    SELECT 'failed' AS outcome, CAST(0 AS BIGINT) AS lists;
  END;
  IF EXISTS (SELECT id FROM incoming GROUP BY id HAVING count(*) > 1) OR EXISTS (SELECT 1 FROM incoming JOIN todo_lists USING (id)) THEN
    SELECT raise_error('a list would be there twice');
  END IF;
  INSERT INTO {todo_lists} (id, user_id, title, color, position, updated_at, deleted_at, change_no)
    SELECT i.id, i.user_id, i.title, i.color, CAST(coalesce(b.base, 0) + row_number() OVER (PARTITION BY i.user_id ORDER BY i.id) - 1 AS INT), :as_of, NULL, 0
    FROM incoming i JOIN users u ON u.id = i.user_id AND u.deleted_at IS NULL
    LEFT JOIN (SELECT user_id, max(position) + 1 AS base FROM todo_lists WHERE deleted_at IS NULL GROUP BY user_id) b ON b.user_id = i.user_id;
  SET made = (SELECT count(*) FROM todo_lists JOIN incoming USING (id));
  SELECT 'made' AS outcome, made AS lists;
END""",
    "renumber_lists": """
BEGIN
  DECLARE place INT DEFAULT 0;
  FOR list AS SELECT id FROM todo_lists WHERE user_id = :user AND deleted_at IS NULL ORDER BY position, id DO
    INSERT INTO {todo_lists} (id, user_id, title, color, position, updated_at, deleted_at, change_no)
      SELECT id, user_id, title, color, place, :as_of, deleted_at, change_no + 1 FROM todo_lists WHERE id = list.id AND position <> place;
    SET place = place + 1;
  END FOR;
  SELECT place AS lists;
END""",
}


def _create(spark: SparkSession, functions: dict[str, str]) -> None:
    for name, body in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")


def create_scalar_functions(spark: SparkSession) -> None:
    _create(spark, SCALAR_FUNCTIONS)


def create_table_functions(spark: SparkSession) -> None:
    _create(spark, TABLE_FUNCTIONS)


@contextmanager
def changed_table(rows: DataFrame, name: str, key: str, path: str) -> Iterator[dict[str, str]]:
    """A table of changes below ``path`` that starts with ``rows``, and the view ``name`` of each key's newest change.

    Gives what :func:`script` needs: the name under which changes are inserted. One session at a time may write. The table and the view are
    dropped at the end; the files stay below ``path``.
    """
    spark = rows.sparkSession
    table = f"{name}_changes_{uuid.uuid4().hex}"
    rows.withColumn("change_no", F.lit(0).cast("bigint")).write.parquet(path)
    spark.catalog.createTable(table, path=path, source="parquet")
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} AS SELECT newest.* FROM (SELECT max_by(struct(*), change_no) AS newest FROM {table} GROUP BY {key})")
    try:
        yield {name: table}
    finally:
        spark.catalog.dropTempView(name)
        spark.sql(f"DROP TABLE {table}")


def script(procedure: str, tables: dict[str, str] | None = None) -> str:
    """The text of a procedure over changed tables."""
    return PROCEDURES[procedure].format(**(tables or {}))


def call(spark: SparkSession, procedure: str, tables: dict[str, str] | None = None, **arguments: Any) -> DataFrame:
    """Run a procedure with bound parameters; gives the rows of its last query. An error inside is raised, unless the script handles it.

    :func:`ledgerlake.sources.results.run_sql` takes :func:`script` and makes errors part of its result.
    """
    return spark.sql(script(procedure, tables), args=arguments)
