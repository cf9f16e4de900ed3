"""Row mutations. Parquet tables take no UPDATE or DELETE, so each mutation returns the table's next snapshot."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions.scalar import struct_json
from ledgerlake.operators.hierarchy import mark_descendants
from ledgerlake.operators.guards import one_per_key
from ledgerlake.operators.ranking import number_rows
from ledgerlake.operators.relational import next_position
from ledgerlake.operators.skew import join_aggregated
from ledgerlake.session import materialize, materialize_counted


def _replace(df: DataFrame, values: Mapping[str, Column], test: Column) -> DataFrame:
    hit = F.coalesce(test, F.lit(False))
    return df.select(
        *[
            F.when(hit, values[f.name]).otherwise(F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name)
            if f.name in values
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def _flagged(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    hit = keys.select(key).distinct().withColumn("__hit", F.lit(True))
    return df.join(hit, key, "left")


# --- insert ----------------------------------------------------------------------------------------------------------


def with_defaults(table: DataFrame, incoming: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """Incoming rows in the table's shape: a missing or null column takes its default, else null."""
    given = set(incoming.columns)
    columns = []
    for field in table.schema.fields:
        value = F.col(field.name) if field.name in given else F.lit(None)
        if field.name in defaults:
            value = F.coalesce(value, defaults[field.name])
        columns.append(value.cast(field.dataType).alias(field.name))
    return incoming.select(*columns)


def insert(table: DataFrame, incoming: DataFrame, defaults: Mapping[str, Column] | None = None) -> DataFrame:
    return table.unionByName(with_defaults(table, incoming, defaults or {}))


def with_positions(
    table: DataFrame, incoming: DataFrame, parent: str, order: Sequence[str], position: str = "position"
) -> DataFrame:
    """Incoming rows numbered after the last active child of their parent, in ``order`` (ending in a unique column)."""
    base = next_position(table, parent, position, "__base")
    joined = join_aggregated(number_rows(incoming, order, within=[parent], name="__rn"), base, [parent])
    place = (F.coalesce(F.col("__base"), F.lit(0)) + F.col("__rn") - 1).alias(position)
    return joined.select(*[c for c in incoming.columns if c != position], place)


# --- update ----------------------------------------------------------------------------------------------------------


def patch(
    table: DataFrame,
    patches: DataFrame,
    key: str,
    columns: Sequence[str],
    as_of: Column,
    seq: str | None = None,
    deleted: str = "deleted_at",
    touched: str = "updated_at",
) -> DataFrame:
    """``COALESCE(new, old)`` on active rows. Several patches of a row apply in ``seq`` order, so per column the last
    value that is not null counts; without ``seq`` a second patch of a row is an error."""
    if seq:
        last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(f"__{c}") for c in columns]
        new = patches.groupBy(key).agg(*last)
    else:
        new = one_per_key(patches.select(key, *columns), [key]).select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = table.join(new.withColumn("__hit", F.lit(True)), key, "left")
    values = {c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in columns} | {touched: as_of}
    return _replace(joined, values, F.col("__hit") & F.col(deleted).isNull()).select(*table.columns)


def soft_delete(
    table: DataFrame,
    keys: DataFrame,
    key: str,
    as_of: Column,
    deleted: str = "deleted_at",
    touched: str = "updated_at",
) -> DataFrame:
    test = F.col("__hit") & F.col(deleted).isNull()
    return _replace(_flagged(table, keys, key), {deleted: as_of, touched: as_of}, test).select(*table.columns)


def toggle(
    table: DataFrame,
    keys: DataFrame,
    key: str,
    as_of: Column,
    flag: str = "is_completed",
    stamped: str = "completed_at",
    deleted: str = "deleted_at",
    touched: str = "updated_at",
) -> DataFrame:
    """Flip the flag of active rows once per listed key, and set or clear the completion time."""
    times = keys.groupBy(key).agg(F.count(F.lit(1)).alias("__times"))
    flipped = F.when(F.col("__times") % 2 == 1, ~F.col(flag)).otherwise(F.col(flag))
    values = {flag: flipped, stamped: F.when(flipped, as_of), touched: as_of}
    test = F.col("__times").isNotNull() & F.col(deleted).isNull()
    return _replace(table.join(times, key, "left"), values, test).select(*table.columns)


# --- delete ----------------------------------------------------------------------------------------------------------


def delete_where(table: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """Kept and removed rows. A predicate that is null removes nothing; the removed rows are the RETURNING set."""
    hit = F.coalesce(predicate, F.lit(False))
    return table.where(~hit), table.where(hit)


@dataclass(frozen=True)
class Reference:
    """``child.column`` refers to ``parent``'s primary key, ON DELETE CASCADE."""

    child: str
    column: str
    parent: str


def cascade_delete(
    tables: Mapping[str, DataFrame],
    keys: Mapping[str, str],
    references: Sequence[Reference],
    table: str,
    removed: DataFrame,
) -> dict[str, DataFrame]:
    """Every table after deleting the rows of ``table`` whose key is in ``removed``, and all that depends on them.

    A chain of tables needs one anti join per reference. A reference of a table to itself is closed by pointer
    doubling. Only references that form a circle between tables need a loop, one round per step of the chain.
    """
    own = {r.child: r for r in references if r.child == r.parent}
    between = [r for r in references if r.child != r.parent]
    gone: dict[str, DataFrame] = {}

    def close(name: str, seeds: DataFrame) -> DataFrame:
        if name not in own:
            return seeds
        return mark_descendants(tables[name], keys[name], own[name].column, seeds).select(keys[name])

    def dependants(ref: Reference, parents: DataFrame) -> DataFrame:
        lost = parents.select(F.col(keys[ref.parent]).alias(ref.column))
        return join_aggregated(tables[ref.child], lost, [ref.column], "left_semi").select(keys[ref.child])

    root = removed.select(F.col(removed.columns[0]).alias(keys[table])).distinct()
    order = _topological([table], between)
    if order is not None:
        gone[table] = close(table, root)
        for name in order[1:]:
            found = [dependants(r, gone[r.parent]) for r in between if r.child == name and r.parent in gone]
            gone[name] = close(name, reduce(DataFrame.unionByName, found).distinct())
    else:
        frontier = {table: materialize(close(table, root), "cascade")}
        gone = dict(frontier)
        while frontier:
            found: dict[str, DataFrame] = {}
            for ref in between:
                if ref.parent in frontier:
                    more = dependants(ref, frontier[ref.parent])
                    found[ref.child] = found[ref.child].unionByName(more) if ref.child in found else more
            frontier = {}
            for name, more in found.items():
                fresh = close(name, more.distinct())
                if name in gone:
                    fresh = fresh.join(gone[name], keys[name], "left_anti")
                fresh, seen = materialize_counted(fresh, "cascade", rows=F.count(F.lit(1)))
                if seen["rows"]:
                    frontier[name] = fresh
                    gone[name] = gone[name].unionByName(fresh) if name in gone else fresh
    return {
        name: join_aggregated(df, gone[name], [keys[name]], "left_anti").select(*df.columns) if name in gone else df
        for name, df in tables.items()
    }


def _topological(roots: list[str], references: Sequence[Reference]) -> list[str] | None:
    """Tables reachable from the roots, parents first; None when the references form a circle."""
    reachable, stack = set(roots), list(roots)
    while stack:
        name = stack.pop()
        for ref in references:
            if ref.parent == name and ref.child not in reachable:
                reachable.add(ref.child)
                stack.append(ref.child)
    edges = [r for r in references if r.parent in reachable]
    order: list[str] = []
    while len(order) < len(reachable):
        ready = [
            n for n in sorted(reachable) if n not in order and all(r.parent in order for r in edges if r.child == n)
        ]
        if not ready:
            return None
        order += ready
    return order if order[0] in roots else None


# --- upsert and audit ------------------------------------------------------------------------------------------------


def upsert_first_wins(
    table: DataFrame,
    incoming: DataFrame,
    key: str,
    seq: str,
    as_of: Column,
    registered: str = "registered_at",
    touched: str = "last_seen_at",
) -> DataFrame:
    """New keys are inserted with their first incoming row; existing rows only get their ``touched`` time."""
    carried = [c for c in table.columns if c not in (key, registered, touched)]
    first = incoming.groupBy(key).agg(F.min_by(F.struct(*carried), seq).alias("__new"))
    old = table.withColumn("__old", F.lit(True))
    joined = old.join(first, key, "full_outer")
    exists = F.coalesce(F.col("__old"), F.lit(False))
    columns = []
    for field in table.schema.fields:
        name = field.name
        if name == key:
            value = F.col(key)
        elif name == registered:
            value = F.when(exists, F.col(name)).otherwise(as_of)
        elif name == touched:
            value = F.when(F.col("__new").isNotNull(), as_of).otherwise(F.col(name))
        else:
            value = F.when(exists, F.col(name)).otherwise(F.col(f"__new.{name}"))
        columns.append(value.cast(field.dataType).alias(name))
    return joined.select(*columns)


def _matched(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old and new row of each key as structs, side by side; null where the row does not exist."""
    before = old.select(F.col(key).alias("__old_key"), F.struct(*old.columns).alias("old"))
    after = new.select(F.col(key).alias("__new_key"), F.struct(*new.columns).alias("new"))
    joined = before.join(after, F.col("__old_key") == F.col("__new_key"), "full_outer")
    return joined.select(F.coalesce("__old_key", "__new_key").cast("string").alias("row_id"), "old", "new")


def matched_images(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old and new row of each key as JSON, nulls kept."""
    return _matched(old, new, key).select(
        "row_id", struct_json(F.col("old")).alias("old_data"), struct_json(F.col("new")).alias("new_data")
    )


def audit(old: DataFrame, new: DataFrame, key: str, table: str, as_of: Column) -> DataFrame:
    """Audit rows for the step from one snapshot to the next. Only rows that changed are turned into JSON.

    A row that did not change gives no entry, where a trigger would log an UPDATE that changes nothing.
    """
    changed = _matched(old, new, key).where(~F.col("old").eqNullSafe(F.col("new")))
    operation = F.when(F.col("old").isNull(), "INSERT").when(F.col("new").isNull(), "DELETE").otherwise("UPDATE")
    return changed.select(
        F.lit(table).alias("table_name"),
        operation.alias("operation"),
        "row_id",
        struct_json(F.col("old")).alias("old_data"),
        struct_json(F.col("new")).alias("new_data"),
        as_of.alias("changed_at"),
    )


def snapshot(table: DataFrame, label: str) -> DataFrame:
    """Write a new snapshot to a fresh path and read it; the caller then points readers at it."""
    return materialize(table, label)
