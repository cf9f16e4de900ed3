"""Names of changes, script files and data files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
DATE_PREFIX = r"^(\d{4}-\d{2}-\d{2})-(.+)$"
SEQUENCE_PREFIX = r"^(\d{3})_(.+)$"
SCRIPT_SUFFIX = r"\.sql\.tmpl$|\.sql$|\.txt$"
NAME_WORDS = r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+"


def change_date(name: Column) -> Column:
    """Date in front of a change name; null when absent or not a calendar date."""
    return F.try_to_date(F.nullif(F.regexp_extract(name, DATE_PREFIX, 1), F.lit("")), "yyyy-MM-dd")


def change_description(name: Column) -> Column:
    return F.when(change_date(name).isNotNull(), F.regexp_extract(name, DATE_PREFIX, 2)).otherwise(name)


def file_sequence(filename: Column) -> Column:
    """The three digits in front of ``_``, else null."""
    return F.nullif(F.regexp_extract(filename, SEQUENCE_PREFIX, 1), F.lit("")).cast("int")


def file_description(filename: Column) -> Column:
    """File name without its extension and sequence prefix."""
    stem = F.regexp_replace(filename, SCRIPT_SUFFIX, "")
    return F.when(stem.rlike(SEQUENCE_PREFIX), F.regexp_extract(stem, SEQUENCE_PREFIX, 2)).otherwise(stem)


def context_key(filename: Column) -> Column:
    """``my-config.json5`` → ``myConfig``; words split at separators, case changes and digits."""
    base = F.regexp_extract(filename, r"([^/]*)$", 1)
    stem = F.when(base.rlike(r"^.+\.[^.]*$"), F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)
    words = F.regexp_extract_all(stem, F.lit(NAME_WORDS), F.lit(0))
    camel = F.array_join(F.transform(words, lambda w: F.initcap(F.lower(w))), "")
    return F.concat(F.lower(F.substring(camel, 1, 1)), F.substr(camel, F.lit(2)))
