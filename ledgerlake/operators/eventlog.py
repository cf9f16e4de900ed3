"""Event log: parse, classify, redact, search, tail, progress and retention."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.functions import events, masking
from ledgerlake.functions.binding import let

# Fixed values.
REQUIRED = ("time", "level", "type", "message")
BLANK = r"^\s*$"


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON lines to log entries. Malformed lines, and lines whose required fields are not strings, are dropped.

    Each line is parsed once: the test is inside the generator, so it is not pushed below the parse and repeated. The
    line is read as the only element of an array, because a lone object may be followed by anything.
    """
    fields = ", ".join([*(f"{name}: VARIANT" for name in REQUIRED), "data: STRING, context: STRING"])

    def text(entry: Column, name: str) -> Column:
        return F.when(F.schema_of_variant(entry[name]) == "STRING", entry[name].cast("string")).alias(name)

    def typed(entry: Column) -> Column:
        return F.struct(*[text(entry, n) for n in REQUIRED], entry["data"].alias("data"), entry["context"].alias("context"))

    def valid(entry: Column) -> Column:
        return reduce(and_, [entry[n].isNotNull() for n in REQUIRED])

    parsed = F.from_json(F.concat(F.lit("["), F.col(column), F.lit("]")), f"ARRAY<STRUCT<{fields}>>")
    entries = let(parsed, lambda es: F.when(F.size(es) == 1, F.filter(F.transform(es, typed), valid)))
    return lines.select(F.inline(entries))


def format_entries(
    raw: DataFrame, keep_data: bool = True, type_column: str = "type", data_column: str = "data", shown: events.Shown = events.Shown()
) -> DataFrame:
    """Raw events (time, type, data) to entries with level and message, and unless ``keep_data`` is off with their whole data."""
    status = F.get_json_object(F.col(data_column), "$.status")
    level = events.entry_level(F.col(type_column), status)
    message = events.event_message(F.col(type_column), F.col(data_column), shown)
    rest = [F.col(c) for c in raw.columns if c not in (type_column, data_column)]
    kept = F.col(data_column) if keep_data else F.lit(None).cast("string")
    return raw.select(
        *rest, F.col(type_column).alias("type"), level.alias("level"), message.alias("message"), kept.alias("data")
    )


def redact(entries: DataFrame, keys: Iterable[str] | None = None, verbose: bool = False) -> DataFrame:
    """Entries with the secrets in their data and context masked."""
    wanted = masking.secret_keys() if keys is None else list(keys)
    return entries.withColumns(
        {c: masking.redact_json(F.col(c), wanted, verbose) for c in ("data", "context") if c in entries.columns}
    )


def threshold(entries: DataFrame, level: str) -> DataFrame:
    return entries.where(events.should_log(F.col("type"), level))


def tail(lines: DataFrame, limit: int | None, column: str = "value") -> DataFrame:
    """Newest ``limit`` entries (``None``: all), with the number of non-blank lines and whether there are more of them than the
    limit. Entries of one time are told apart by their other fields, so the same ones are kept in every run."""
    total = lines.where(~F.col(column).rlike(BLANK)).agg(F.count(F.lit(1))).scalar()
    entries = parse_lines(lines, column)
    newest = entries.orderBy(F.col("time").desc(), *[F.col(c) for c in entries.columns if c != "time"])
    if limit is not None:
        newest = newest.limit(limit)
    more = F.lit(False) if limit is None else total > limit
    return newest.select("*", total.alias("total_lines"), more.alias("has_more"))


def run_progress(log: DataFrame, run: str = "run_id") -> DataFrame:
    """Running counters of each run, from its file and build events (batch or streaming).

    Input: ``run_id, seq, type, status, filepath, file_count``; ``seq`` orders the events of a run.
    """
    kind = F.col("type")
    good = F.coalesce(F.col("status") == "success", F.lit(False))
    finished = kind.isin("file:after", "file:dry-run")
    phase = F.when(kind == "build:start", "running").when(kind == "build:complete", "complete")
    moves = kind.isin("file:before", "file:after", "file:dry-run", "build:start", "build:complete")
    current = F.when(kind == "file:before", F.col("filepath"))
    seq = F.col("seq")
    return log.groupBy(run).agg(
        F.count_if((kind == "file:after") & good).alias("files_run"),
        F.count_if(kind == "file:skip").alias("files_skipped"),
        F.count_if(finished & ~good).alias("files_failed"),
        F.count_if((kind == "file:dry-run") & good).alias("files_dry_run"),
        F.max_by("file_count", F.when(kind == "build:start", seq)).alias("files_total"),
        F.coalesce(F.max_by(phase, F.when(phase.isNotNull(), seq)), F.lit("idle")).alias("phase"),
        F.max_by("status", F.when(kind == "build:complete", seq)).alias("status"),
        F.max_by(current, F.when(moves, seq)).alias("current_file"),
    )


def months_before(as_of: Column, months: int) -> Column:
    """The same day and time some months earlier; a day the month does not have becomes its last day."""
    return as_of - F.make_ym_interval(F.lit(0), F.lit(months))


def retained(history: DataFrame, as_of: Column, months: int, time: str = "executed_at") -> DataFrame:
    return history.where(F.col(time) >= months_before(as_of, months))


def dropped(history: DataFrame, as_of: Column, months: int, time: str = "executed_at") -> DataFrame:
    return history.where(~(F.col(time) >= months_before(as_of, months)))
