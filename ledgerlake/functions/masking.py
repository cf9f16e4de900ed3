"""Masking of secret values, alone and inside JSON text.

JSON is not parsed into rows or objects: its text is cut by one regular expression into pairs ``"key": "string"`` and
runs of anything else, and pairs with a secret key are replaced. Nested objects and arrays need no recursion, and all
that is not masked keeps its exact text. The quantifiers are possessive, so long strings do not deepen the matcher's
stack.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlake.functions.binding import let

# Fixed values.
MASK_LENGTH = 12
REVEAL_LENGTH = 4
SECRET_FIELDS = (
    "password",
    "pass",
    "secret",
    "token",
    "key",
    "credential",
    "api_key",
    "apikey",
    "access_key",
    "secret_key",
    "db_pass",
    "db_password",
    "redis_pass",
    "client_secret",
    "private_key",
    "encryption_key",
    "auth_token",
    "bearer_token",
    "jwt_secret",
    "session_secret",
)

_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_PAIR = rf'{_STRING}\s*+:\s*+{_STRING}'
_CUT = rf'{_PAIR}|(?:[^"]++|(?!{_PAIR}){_STRING})++|"'


def spellings(field: str) -> set[str]:
    """The ways a field name is written: camel, snake, kebab, title, without separators, lower and upper."""
    parts = [p for p in re.split(r"[-_\s]+", field) if p]
    words = [w.lower() for p in parts for w in re.sub(r"([a-z])([A-Z])", r"\1 \2", p).split(" ")]
    joined = "".join(parts)
    camel = parts[0] + "".join(p[0].upper() + p[1:] for p in parts[1:]) if parts else ""
    return {
        field, field.lower(), field.upper(),
        camel[:1].lower() + camel[1:], "_".join(words), "-".join(words), "".join(w.capitalize() for w in words),
        joined, joined.lower(), joined.upper(),
    }


def secret_keys(extra: Iterable[str] = (), prefix: str | None = None) -> list[str]:
    """Every spelling of the secret fields, and of the same fields behind an environment-variable ``prefix``."""
    keys: set[str] = set()
    for field in [*SECRET_FIELDS, *extra]:
        keys |= spellings(field)
        if prefix:
            keys |= spellings(f"{prefix}_{field}")
    return sorted(keys)


def title_label(key: Column) -> Column:
    """``api_key`` and ``apiKey`` → ``ApiKey``."""
    spaced = F.regexp_replace(F.regexp_replace(key, r"[-_\s]+", " "), "([a-z])([A-Z])", "$1 $2")
    return F.replace(F.initcap(F.lower(spaced)), F.lit(" "), F.lit(""))


def _utf16_length(value: Column) -> Column:
    """Length in UTF-16 units: characters outside the basic plane count twice."""
    astral = F.regexp_count(value, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    return F.length(value) + F.when(F.octet_length(value) == F.length(value), 0).otherwise(astral)


def mask_value(value: Column, key: Column, verbose: bool = False) -> Column:
    """``<Label ****... (length) />``: at most 12 stars, ``...`` beyond; verbose shows up to 4 leading characters."""
    return let(F.struct(value.alias("text"), _utf16_length(value).alias("length")), lambda v: _mask(v, key, verbose))


def _mask(value: Column, key: Column, verbose: bool) -> Column:
    length = value["length"]
    shown = F.least(length, F.lit(MASK_LENGTH))
    masked = F.repeat(F.lit("*"), shown)
    if verbose:
        reveal = F.least(F.ceil(length / 5), F.lit(REVEAL_LENGTH)).cast("int")
        visible = F.rpad(F.substr(value["text"], F.lit(1), reveal), shown, F.lit("*"))
        masked = F.when(length >= REVEAL_LENGTH, visible).otherwise(masked)
    more = F.when(length > MASK_LENGTH, F.lit("...")).otherwise(F.lit(""))
    return F.concat(
        F.lit("<"), title_label(key), F.lit(" "), masked, more, F.lit(" ("), length.cast("string"), F.lit(") />")
    )


def _unquoted(literal: Column) -> Column:
    """The text of a JSON string literal; only one with an escape needs a parser."""
    parsed = F.get_json_object(F.concat(F.lit('{"v":'), literal, F.lit("}")), "$.v")
    plain = F.substr(literal, F.lit(2), F.length(literal) - 2)
    return F.when(F.contains(literal, F.lit("\\")), F.coalesce(parsed, plain)).otherwise(plain)


def _quoted(text: Column) -> Column:
    """A string as a JSON literal."""
    return let(F.to_json(F.struct(text.alias("v"))), lambda j: F.substr(j, F.lit(6), F.length(j) - 6))


def redact_json(data: Column, keys: Iterable[str], verbose: bool = False) -> Column:
    """JSON text with the string value of every secret key masked, at any depth. A key counts as a parser reads it, whatever
    escapes it is written with. A text that names no secret key and has no escape is passed on as it is."""
    wanted = list(keys)
    hit = "|".join([*(re.escape(k) for k in wanted), r"\\"])

    def replaced(text: Column, key: Column, literal: Column) -> Column:
        masked = mask_value(_unquoted(literal), key, verbose)
        # Without revealed characters the mask has nothing to escape, unless the key has.
        shown = _quoted(masked)
        return F.concat(F.substr(text, F.lit(1), F.length(text) - F.length(literal)), shown)

    def redact(text: Column) -> Column:
        # Only a pair starts with a quote and has a literal behind the colon.
        written = F.regexp_extract(text, f"^{_STRING}", 0)
        literal = F.regexp_replace(F.substr(text, F.length(written) + 1), r"^\s*+:\s*+", "")
        pair = F.struct(_unquoted(written).alias("key"), literal.alias("literal"))
        masked = let(
            pair,
            lambda p: F.when(F.startswith(p["literal"], F.lit('"')) & p["key"].isin(wanted), replaced(text, p["key"], p["literal"])).otherwise(text),
        )
        return F.when(F.startswith(text, F.lit('"')), masked).otherwise(text)

    cut = F.array_join(F.transform(F.regexp_extract_all(data, F.lit(_CUT), F.lit(0)), redact), "")
    return F.when(data.rlike(hit), cut).otherwise(data)
