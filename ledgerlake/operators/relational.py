"""Views, lookups, joins and reports over parent and child tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.operators.skew import join_aggregated

# --- projection and filter -------------------------------------------------------------------------------------------


def active(df: DataFrame, deleted: str = "deleted_at") -> DataFrame:
    return df.where(F.col(deleted).isNull())


def active_view(df: DataFrame, hidden: Sequence[str] = ("password_hash",), deleted: str = "deleted_at") -> DataFrame:
    """Rows not soft-deleted, without the hidden columns."""
    return active(df, deleted).select(*[c for c in df.columns if c not in (*hidden, deleted)])


def lookup(df: DataFrame, column: str, value, deleted: str = "deleted_at") -> DataFrame:
    return active(df, deleted).where(F.col(column) == F.lit(value))


def children_of(df: DataFrame, parent: str, value, order: Sequence[str], deleted: str = "deleted_at") -> DataFrame:
    return lookup(df, parent, value, deleted).orderBy(*order)


def _shown(df: DataFrame, column: str) -> Column:
    """A cell as it is displayed: null as ``NULL``, nested values as JSON."""
    kind = df.schema[column].dataType.typeName()
    cell = F.col(f"`{column}`")
    text = F.to_json(cell) if kind in ("struct", "array", "map", "variant") else cell.cast("string")
    return F.coalesce(text, F.lit("NULL"))


def search(df: DataFrame, term: str, column: str | None = None) -> DataFrame:
    """Rows with the term, case-insensitive, in any displayed column or in one."""
    if not term:
        return df
    needle = F.lit(term.lower())
    columns = [column] if column else df.columns
    return df.where(reduce(or_, [F.contains(F.lower(_shown(df, c)), needle) for c in columns]))


def search_log(entries: DataFrame, term: str) -> DataFrame:
    if not term:
        return entries
    needle = F.lit(term.lower())
    return entries.where(reduce(or_, [F.contains(F.lower(F.col(c)), needle) for c in ("type", "message", "level")]))


def exclude_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose name does not start with the internal prefix; rows without a name stay."""
    return df.where(~F.coalesce(F.startswith(F.col(column), F.lit(prefix)), F.lit(False)))


def member_of(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.where(F.col(column).isin(list(values)))


# --- joins -----------------------------------------------------------------------------------------------------------


def join_active(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str, carry: Mapping[str, str]):
    """Active children with the ``carry`` columns (name → new name) of their active parent."""
    side = active(parents).select(
        F.col(parent_key).alias("__key"), *[F.col(c).alias(new) for c, new in carry.items()]
    )
    kept = active(children)
    return kept.join(side, kept[child_key] == side["__key"], "inner").drop("__key")


def with_match(df: DataFrame, other: DataFrame, key: str, other_key: str, unique: bool = False) -> DataFrame:
    """``key IN (SELECT other_key …)``: the other side is reduced to its keys before it moves. ``unique``: no key of ``df`` is repeated,
    so that none can be hot and the keys need not be salted."""
    return _by_key(df, other.select(F.col(other_key).alias(key)).distinct(), key, "left_semi", unique)


def without_match(df: DataFrame, other: DataFrame, key: str, other_key: str, unique: bool = False) -> DataFrame:
    """``NOT EXISTS`` a row of the other side with this key; ``unique`` as in :func:`with_match`."""
    return _by_key(df, other.select(F.col(other_key).alias(key)).distinct(), key, "left_anti", unique)


def _by_key(df: DataFrame, keys: DataFrame, key: str, how: str, unique: bool) -> DataFrame:
    joined = df.join(keys, key, how) if unique else join_aggregated(df, keys, [key], how)
    return joined.select(*df.columns)


def with_parent(df: DataFrame, key: str, parent: str, carry: Mapping[str, str]) -> DataFrame:
    """Self-referencing join: each row with the ``carry`` columns of its parent row, null at the top."""
    side = df.select(F.col(key).alias("__key"), *[F.col(c).alias(new) for c, new in carry.items()])
    return df.join(side, df[parent] == side["__key"], "left").drop("__key")


# --- counts per parent -----------------------------------------------------------------------------------------------


def count_per_parent(
    parents: DataFrame,
    children: DataFrame,
    parent_key: str,
    child_key: str,
    counts: Mapping[str, Column | None],
    padded: Sequence[str] = (),
) -> DataFrame:
    """Parents with counts of their children, each count under its own condition (None counts all).

    Children are counted by key first, so a hot parent shrinks to one row per task before the shuffle, and only counts
    meet the parents. A parent without children gets 0; a count named in ``padded`` gets 1, which is what a condition
    on a nullable child column sees in the null-padded row of an outer join.
    """
    aggregates = [
        (F.count(F.lit(1)) if test is None else F.count_if(test)).alias(name) for name, test in counts.items()
    ]
    counted = children.groupBy(F.col(child_key).alias("__key")).agg(*aggregates)
    joined = parents.join(counted, parents[parent_key] == counted["__key"], "left")
    filled = [
        F.when(F.col("__key").isNull(), F.lit(1 if name in padded else 0)).otherwise(F.col(name)).cast("bigint").alias(name)
        for name in counts
    ]
    return joined.select(*[parents[c] for c in parents.columns], *filled)


def lists_with_counts(lists: DataFrame, items: DataFrame, padded: bool = False) -> DataFrame:
    """Active lists with total, completed and pending item counts.

    ``padded`` gives a list without items a total of 1, as the ``SUM(CASE WHEN …)`` form of this view does.
    """
    alive = F.col("deleted_at").isNull()
    counts = {
        "total_items": alive,
        "completed_items": alive & F.col("is_completed"),
        "pending_items": alive & ~F.col("is_completed"),
    }
    return count_per_parent(active(lists), items, "id", "list_id", counts, ("total_items",) if padded else ())


# --- aggregation -----------------------------------------------------------------------------------------------------


def duplicated(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > 1)


def joined_text(df: DataFrame, keys: Sequence[str], value: str, separator: str, name: str) -> DataFrame:
    """Distinct values of a group as one ordered text.

    Values are made distinct before they are collected, so a group's text is bounded by its value domain.
    """
    distinct = df.select(*keys, value).distinct()
    return distinct.groupBy(*keys).agg(
        F.expr(f"listagg(cast(`{value}` AS STRING), '{separator}') WITHIN GROUP (ORDER BY `{value}`)").alias(name)
    )


def ordered_array(df: DataFrame, keys: Sequence[str], position: str, value: str, name: str) -> DataFrame:
    """Values of a group as an array in position order; for groups of key columns, which a table's width bounds."""
    pairs = F.collect_list(F.struct(F.col(position).alias("p"), F.col(value).alias("v")))
    return df.groupBy(*keys).agg(F.transform(F.array_sort(pairs), lambda e: e["v"]).alias(name))


def value_set(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Sorted set of a group's values, merged per task before the shuffle."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias(name))


def next_position(df: DataFrame, parent: str, position: str = "position", name: str = "next_position") -> DataFrame:
    """Position after the last active child, per parent."""
    return active(df).groupBy(parent).agg((F.coalesce(F.max(position), F.lit(-1)) + 1).alias(name))


def table_counts(tables: Mapping[str, DataFrame | None]) -> DataFrame:
    """Row count of every table in one job; a table that could not be opened counts 0."""
    spark = next(df.sparkSession for df in tables.values() if df is not None)
    parts = []
    for name, df in tables.items():
        if df is None:
            parts.append(spark.range(1).select(F.lit(name).alias("table"), F.lit(0).cast("bigint").alias("count")))
        else:
            parts.append(df.agg(F.count(F.lit(1)).alias("count")).select(F.lit(name).alias("table"), "count"))
    return reduce(DataFrame.unionByName, parts)


def tagged_union(parts: Mapping[str, DataFrame], tag: str = "type") -> DataFrame:
    """UNION ALL with a literal that names the branch."""
    return reduce(
        DataFrame.unionByName, [df.select(F.lit(name).alias(tag), *df.columns) for name, df in parts.items()]
    )
