"""Event names to levels, and events with their data to messages."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlake.functions.binding import let

# An event belongs to the first level whose pattern it matches, else to debug.
LEVEL_PATTERNS = {
    "error": r"^error$|:error$|:failed$",
    "warn": r":warning$|:blocked$|:expired$",
    "info": (
        r":(start|complete|created|deleted|updated|activated|loaded|persisted|migrated|acquired|released|resolved"
        r"|open|close|set|rotated|flushed|started|initialized|after|skip|dry-run)$"
    ),
}
LEVEL_RANK = {"error": 1, "warn": 2, "info": 3, "debug": 4}

# Message text per event. ``{field}`` is the field's value, ``{#field}`` the length of an array field,
# ``{,field}`` an array field joined by commas. A name with ``!`` is the text for when the event's test fails.
MESSAGES = {
    "file:before": "Executing {filepath}",
    "file:after": "Executed {filepath} ({durationMs}ms)",
    "file:after!": "Failed {filepath}: {error}",
    "file:skip": "Skipped {filepath} ({reason})",
    "change:start": "Starting {direction} for {name} ({#files} files)",
    "change:file": "{change}: {filepath} ({index}/{total})",
    "change:complete": "{direction} {name}: {status} ({durationMs}ms)",
    "build:start": "Starting schema build ({fileCount} files)",
    "build:complete": "Build complete: {filesRun} run, {filesSkipped} skipped ({durationMs}ms)",
    "build:complete!": "Build failed after {filesRun} files ({durationMs}ms)",
    "run:file": "Running {filepath} on {configName}",
    "run:dir": "Running directory {dirpath} ({fileCount} files) on {configName}",
    "lock:acquiring": "Acquiring lock for {configName} as {identity}",
    "lock:acquired": "Lock acquired for {configName}",
    "lock:released": "Lock released for {configName}",
    "lock:blocked": "Lock blocked: {configName} held by {holder}",
    "lock:expired": "Lock expired for {configName} (was held by {previousHolder})",
    "state:loaded": "State loaded: {configCount} configs, version {version}",
    "state:persisted": "State saved: {configCount} configs",
    "state:migrated": "State migrated from {from} to {to}",
    "config:created": "Created config: {name}",
    "config:updated": "Updated config {name}: {,fields}",
    "config:deleted": "Deleted config: {name}",
    "config:activated": "Activated config: {name} (was {previous})",
    "config:activated!": "Activated config: {name}",
    "secret:set": "Set secret {key} for {configName}",
    "secret:deleted": "Deleted secret {key} from {configName}",
    "global-secret:set": "Set global secret: {key}",
    "global-secret:deleted": "Deleted global secret: {key}",
    "db:creating": "Creating database {database} for {configName}",
    "db:created": "Created database {database} ({durationMs}ms)",
    "db:destroying": "Destroying database {database} for {configName}",
    "db:destroyed": "Destroyed database {database}",
    "db:bootstrap": "Bootstrapped {#tables} tables for {configName}",
    "template:render": "Rendered template {filepath} ({durationMs}ms)",
    "template:load": "Loaded {format} data from {filepath}",
    "identity:resolved": "Identity resolved: {name} ({source})",
    "identity:created": "Created identity: {name} <{email}>",
    "identity:synced": "Synced {discovered} identities for {configName}",
    "identity:registered": "Registered identity for {configName}",
    "config:exported": "Exported {configName} to {recipient}",
    "config:imported": "Imported {configName} from {from}",
    "connection:open": "Connected to {configName} ({dialect})",
    "connection:close": "Disconnected from {configName}",
    "connection:error": "Connection error for {configName}: {error}",
    "logger:started": "Logger started: {file} at {level} level",
    "logger:rotated": "Rotated log: {oldFile} -> {newFile}",
    "logger:flushed": "Flushed {entriesWritten} log entries",
    "settings:loaded": "Settings loaded from {path}",
    "settings:saved": "Settings saved to {path}",
    "settings:initialized": "Settings initialized at {path} (forced)",
    "settings:initialized!": "Settings initialized at {path}",
}
# The tests of these events, a field that is ``success`` or one that is set.
SUCCESS_TESTS = {"file:after": "status", "build:complete": "status"}
PRESENCE_TESTS = {"config:activated": "previous", "settings:initialized": "force"}


def classify_event(event: Column) -> Column:
    out = None
    for level, pattern in LEVEL_PATTERNS.items():
        test = event.rlike(pattern)
        out = F.when(test, F.lit(level)) if out is None else out.when(test, F.lit(level))
    return out.otherwise(F.lit("debug"))


def level_rank(level: Column) -> Column:
    out = None
    for name, rank in LEVEL_RANK.items():
        out = F.when(level == name, rank) if out is None else out.when(level == name, rank)
    return out


def should_log(event: Column, threshold: str) -> Column:
    """Silent keeps nothing, verbose keeps all, else the event's level must be at least as severe."""
    if threshold == "silent":
        return F.lit(False)
    if threshold == "verbose":
        return F.lit(True)
    return level_rank(classify_event(event)) <= LEVEL_RANK[threshold]


def entry_level(event: Column, status: Column) -> Column:
    """Level of an entry: a completion whose status is neither success nor skipped (or is missing) is an error."""
    finished = F.endswith(event, F.lit(":complete")) | F.endswith(event, F.lit(":after"))
    good = F.coalesce(status.isin("success", "skipped"), F.lit(False))
    return F.when(finished & ~good, F.lit("error")).otherwise(classify_event(event))


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("null"))


def _array_size(value: Column) -> Column:
    return F.size(F.try_variant_get(value, "$", "array<variant>"))


def _object_keys(value: Column) -> Column:
    return F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))


@dataclass(frozen=True)
class Shown:
    """How much of its data a message shows; ``None`` is all. The defaults are the display form readers expect."""

    fields: int | None = 3
    text: int | None = 50
    error_text: int | None = 30
    where: int | None = 100


WHOLE = Shown(None, None, None, None)


def _summary(value: Column, longest: int | None, nested: bool) -> Column:
    """A value as a message shows it: strings cut to ``longest``, containers replaced by their size (or by ``[...]``)."""
    return let(_kind(value), lambda kind: _shortened(value, kind, longest, nested))


def _shortened(value: Column, kind: Column, longest: int | None, nested: bool) -> Column:
    text = _text(value)
    quoted = F.concat(F.lit('"'), text, F.lit('"'))
    string = quoted
    if longest is not None:
        cut = F.concat(F.lit('"'), F.substring(text, 1, longest - 3), F.lit('..."'))
        string = F.when(F.length(text) > longest, cut).otherwise(quoted)
    array = F.concat(F.lit("["), _array_size(value).cast("string"), F.lit(" items]")) if nested else F.lit("[...]")
    obj = (
        F.concat(F.lit("{"), F.size(_object_keys(value)).cast("string"), F.lit(" keys}")) if nested else F.lit("[...]")
    )
    return (
        F.when(value.isNull() | (kind == "VOID"), F.lit("null"))
        .when(kind == "STRING", string)
        .when(F.startswith(kind, F.lit("ARRAY")), array)
        .when(F.startswith(kind, F.lit("OBJECT")), obj)
        .otherwise(text)
    )


def _fields(data: Column) -> Column:
    """Top-level fields of a JSON object, in the order they are written."""
    return F.from_json(data, "map<string,variant>")


def _field(fields: Column, name: Column) -> Column:
    """Field as it prints inside a message: a field that is not there prints as ``undefined``."""
    value = F.try_element_at(fields, name)
    present = F.coalesce(F.map_contains_key(fields, name), F.lit(False))
    return F.when(present, _text(value)).otherwise(F.lit("undefined"))


def _truthy(fields: Column, name: str) -> Column:
    value = F.try_element_at(fields, F.lit(name))
    return F.coalesce(~value.cast("string").isin("", "false", "0"), F.lit(False))


def _templates() -> Column:
    """Map from event to the parts of its text; a constant that the optimizer folds."""
    parts = {
        event: [
            {"text": text, "mark": mark, "name": name}
            for text, mark, name in re.findall(r"([^{]+)|\{([#,]?)(\w+)\}", template)
        ]
        for event, template in MESSAGES.items()
    }
    return F.from_json(F.lit(json.dumps(parts)), "map<string,array<struct<text:string,mark:string,name:string>>>")


def _render(part: Column, fields: Column) -> Column:
    value = F.try_element_at(fields, part["name"])
    joined = F.array_join(F.try_variant_get(value, "$", "array<string>"), ", ")
    return (
        F.when(part["name"] == "", part["text"])
        .when(part["mark"] == "#", F.coalesce(_array_size(value), F.lit(0)).cast("string"))
        .when(part["mark"] == ",", F.coalesce(joined, F.lit("undefined")))
        .otherwise(_field(fields, part["name"]))
    )


def _first_entries(fields: Column, separator: str, count: int | None, show) -> Column:
    entries = F.map_entries(fields) if count is None else F.slice(F.map_entries(fields), 1, count)
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(separator), show(e["value"]))), ", ")


def _error_text(fields: Column, shown: Shown) -> Column:
    """An error value: its message, a database error's code, or a summary of its first fields."""
    value = F.try_element_at(fields, F.lit("error"))
    inner = F.try_variant_get(value, "$", "map<string,variant>")

    def part(name):
        return F.try_element_at(inner, F.lit(name)).cast("string")

    message = F.try_element_at(inner, F.lit("message"))
    database = F.concat(
        part("severity"),
        F.lit(" "),
        part("code"),
        F.when(_truthy(inner, "routine"), F.concat(F.lit(" in "), part("routine"))).otherwise(F.lit("")),
        F.when(
            _truthy(inner, "where"),
            F.concat(F.lit(" - "), part("where") if shown.where is None else F.substring(part("where"), 1, shown.where)),
        ).otherwise(F.lit("")),
    )
    summary = F.concat(F.lit("{"), _first_entries(inner, ": ", shown.fields, lambda v: _summary(v, shown.error_text, nested=False)), F.lit("}"))
    return (
        F.when(value.isNull() | (_kind(value) == "VOID"), F.lit("Unknown error"))
        .when(_kind(message) == "STRING", message.cast("string"))
        .when(_truthy(inner, "code") & _truthy(inner, "severity"), database)
        .when(F.size(inner) > 0, summary)
        .otherwise(_text(value))
    )


def event_message(event: Column, data: Column, shown: Shown = Shown()) -> Column:
    """Message of an event: its template, else its name with its first fields. The data is parsed once; it is not changed, so what
    a message leaves out stays there."""
    return let(_fields(F.coalesce(data, F.lit("{}"))), lambda fields: _message(event, fields, shown))


def _message(event: Column, fields: Column, shown: Shown) -> Column:
    passed = F.lit(True)
    for name, field in SUCCESS_TESTS.items():
        success = F.try_element_at(fields, F.lit(field)).cast("string") == "success"
        passed = F.when(event == name, F.coalesce(success, F.lit(False))).otherwise(passed)
    for name, field in PRESENCE_TESTS.items():
        passed = F.when(event == name, _truthy(fields, field)).otherwise(passed)
    parts = F.try_element_at(_templates(), F.when(passed, event).otherwise(F.concat(event, F.lit("!"))))
    from_template = let(parts, lambda ps: F.array_join(F.transform(ps, lambda p: _render(p, fields)), ""))

    logger_error = F.coalesce(
        F.try_variant_get(F.try_element_at(fields, F.lit("error")), "$.message", "string"), _field(fields, F.lit("error"))
    )
    source = F.concat(F.lit("Error in "), _field(fields, F.lit("source")), F.lit(": "))
    plain = F.replace(event, F.lit(":"), F.lit(" "))
    listed = F.concat(plain, F.lit(": "), _first_entries(fields, "=", shown.fields, lambda v: _summary(v, shown.text, nested=True)))
    other = F.when(F.coalesce(F.size(fields), F.lit(0)) > 0, listed).otherwise(plain)
    return (
        F.when(event == "logger:error", F.concat(F.lit("Logger error: "), logger_error))
        .when(event == "error", F.concat(source, _error_text(fields, shown)))
        .otherwise(F.coalesce(from_template, other))
    )
