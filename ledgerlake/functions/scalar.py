"""Labels, checks, hashes, quoting and formatting."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
PRIORITY_LABELS = {0: "None", 1: "Low", 2: "Medium", 3: "High"}
HEX_COLOR = "^#[0-9A-Fa-f]{6}$"
SIZE_TEXT = r"^(\d+(?:\.\d+)?)\s*(b|kb|mb|gb)?$"
SIZE_UNITS = {"b": 1, "kb": 1024, "mb": 1024 * 1024, "gb": 1024 * 1024 * 1024}
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def label_of(value: Column, labels: Mapping, otherwise: str | None = None) -> Column:
    """CASE value WHEN … END over a fixed mapping."""
    out = None
    for key, text in labels.items():
        test = value == F.lit(key)
        out = F.when(test, F.lit(text)) if out is None else out.when(test, F.lit(text))
    return out if otherwise is None else out.otherwise(F.lit(otherwise))


def priority_label(value: Column) -> Column:
    return label_of(value, PRIORITY_LABELS, "Unknown")


def first_present(*values: Column) -> Column:
    return F.coalesce(*values)


def trimmed_length(value: Column) -> Column:
    """Length that ignores trailing blanks, as some databases count it."""
    return F.length(F.regexp_replace(value, " +$", ""))


def day_difference(end: Column, start: Column) -> Column:
    """Day boundaries crossed, not full 24-hour days."""
    return F.datediff(F.to_date(end), F.to_date(start))


def is_email(value: Column) -> Column:
    """``@`` and, at or after it, a ``.``; null is not an email."""
    at = F.instr(value, "@")
    dot = F.locate(".", F.substring(value, at, F.length(value)))
    return F.coalesce((at > 0) & (dot > 0), F.lit(False))


def is_hex_color(value: Column) -> Column:
    """``#RRGGBB``; null is valid because the field is optional."""
    return F.coalesce(value.rlike(HEX_COLOR), F.lit(True))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def identity_hash(email: Column, name: Column, machine: Column, os: Column) -> Column:
    """SHA-256 over the NUL-joined fields; null when a field is missing or empty."""
    fields = [email, name, machine, os]
    complete = F.lit(True)
    for field in fields:
        complete = complete & (F.coalesce(field, F.lit("")) != "")
    return F.when(complete, F.sha2(F.concat_ws("\0", *fields), 256))


def require_identity_hash(*fields: Column) -> Column:
    """As :func:`identity_hash`, but a missing field fails the query."""
    return F.coalesce(
        identity_hash(*fields),
        F.raise_error(F.lit("identity hash needs email, name, machine and os")).cast("string"),
    )


def sql_escape(value: Column) -> Column:
    return F.replace(value, F.lit("'"), F.lit("''"))


def sql_quote(value: Column) -> Column:
    """SQL literal of a value. For emitted text only: queries bind parameters instead."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("NULL")).otherwise(F.concat(F.lit("'"), sql_escape(text), F.lit("'")))


def pad_id(value: Column, width: int = 6) -> Column:
    """Left-pad with zeros; longer values stay whole."""
    text = value.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def iso_date(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd")


def iso_timestamp(value: Column) -> Column:
    return F.date_format(value, ISO_FORMAT)


def compact_number(value: Column) -> Column:
    """1500 → 1.5K, 2300000 → 2.3M, smaller numbers unchanged."""

    def scaled(unit: int, suffix: str) -> Column:
        # The pattern rounds the exact double half to even. Only x.25 and x.75 are exact halves, and halves go up.
        up = F.when(value % unit == unit // 4, value + 1).otherwise(value)
        return F.concat(F.call_function("format_number", up.cast("double") / unit, F.lit("0.0")), F.lit(suffix))

    return (
        F.when(value >= 1_000_000, scaled(1_000_000, "M"))
        .when(value >= 1_000, scaled(1_000, "K"))
        .otherwise(value.cast("string"))
    )


def size_bytes(text: Column) -> Column:
    """``'10mb'`` → bytes; null for text that is no size."""
    low = F.lower(text)
    number = F.regexp_extract(low, SIZE_TEXT, 1)
    unit = F.regexp_extract(low, SIZE_TEXT, 2)
    factor = label_of(unit, {k: v for k, v in SIZE_UNITS.items() if k != "b"}).cast("bigint")
    return F.when(
        low.rlike(SIZE_TEXT),
        F.floor(number.try_cast("double") * F.coalesce(factor, F.lit(SIZE_UNITS["b"]).cast("bigint"))),
    )


def struct_json(row: Column) -> Column:
    """A struct as JSON, nulls kept."""
    return F.to_json(row, {"ignoreNullFields": "false"})


def row_json(df: DataFrame) -> Column:
    """The whole row as JSON, nulls kept."""
    return struct_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))


def new_uuid() -> Column:
    return F.uuid()


def iso_now() -> Column:
    return iso_timestamp(F.current_timestamp())
