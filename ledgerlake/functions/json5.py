"""JSON5 documents as strict JSON, token by token, in column functions.

A document is cut into tokens by one expression, each token is rewritten, and the tokens are joined again. Nothing inside a string is taken for
anything else, and what is no JSON5 stays as it is, so that the parser rejects it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlake.functions.binding import let

# The grammar of JSON5.
LINE_ENDS = r"\n\r\x{2028}\x{2029}"
SPACE = r"[\s\x{0B}\x{A0}\x{FEFF}\p{Zs}\x{2028}\x{2029}]"
COMMENT = rf"/\*(?:[^*]|\*(?!/))*+\*/|//[^{LINE_ENDS}]*+"
BETWEEN = rf"(?:{SPACE}|{COMMENT})*+"
STRING = r""""[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"|'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+'"""
NAME = r"(?:[\p{L}\p{Nl}$_]|\\u[0-9a-fA-F]{4})(?:[\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}$\x{200C}\x{200D}]|\\u[0-9a-fA-F]{4})*+"
NUMBER = r"[+-]?(?:0[xX][0-9a-fA-F]++|Infinity|NaN|(?:[0-9]++(?:\.[0-9]*+)?|\.[0-9]++)(?:[eE][+-]?[0-9]++)?)"
TOKEN = rf"{STRING}|{COMMENT}|{NAME}(?={BETWEEN}:)|{NUMBER}|{NAME}|{SPACE}++|[\s\S]"
ESCAPE = r"\\(?:\r\n|u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|[\s\S])|[^\\]++"
KEPT_ESCAPES = '"\\/bfnrtu'


def _piece(piece: Column) -> Column:
    """One escape, or a run without any, of a string."""
    second = F.substring(piece, 2, 1)
    escape = (
        F.when(second.rlike(rf"[{LINE_ENDS}]"), "")  # a line goes on
        .when(second == "x", F.concat(F.lit("\\u00"), F.substring(piece, 3, 2)))
        .when(second == "v", "\\u000b")
        .when(second == "0", "\\u0000")
        .when(F.instr(F.lit(KEPT_ESCAPES), second) > 0, piece)
        .otherwise(second)
    )
    plain = F.replace(F.replace(piece, F.lit('"'), F.lit('\\"')), F.lit("\t"), F.lit("\\t"))
    return F.when(F.startswith(piece, F.lit("\\")), escape).otherwise(plain)


def _string(token: Column) -> Column:
    inner = F.substring(token, F.lit(2), F.length(token) - 2)
    return F.concat(F.lit('"'), F.array_join(F.transform(F.regexp_extract_all(inner, F.lit(ESCAPE), F.lit(0)), _piece), ""), F.lit('"'))


def _number(token: Column) -> Column:
    """Hexadecimal digits beyond 64 bits become the largest number of 64 bits."""
    sign = F.when(F.startswith(token, F.lit("-")), "-").otherwise("")
    size = F.regexp_replace(token, "^[+-]", "")
    decimal = F.regexp_replace(F.regexp_replace(F.regexp_replace(size, r"^\.", "0."), r"\.(?=$|[eE])", ""), r"^0+(?=[0-9])", "")
    shown = (
        F.when(size.rlike("^0[xX]"), F.conv(F.substring(size, F.lit(3), F.length(size)), 16, 10))
        .when(size.rlike("^[IN]"), size)
        .otherwise(decimal)
    )
    value = F.concat(sign, shown)
    # strict JSON has no such numbers; as texts they are still read into a floating column
    return F.when(size.rlike("^[IN]"), F.concat(F.lit('"'), F.when(shown == "NaN", shown).otherwise(value), F.lit('"'))).otherwise(value)


def _token(token: Column, following: Column) -> Column:
    first = F.substring(token, 1, 1)
    return (
        F.when(first.isin('"', "'"), _string(token))
        .when(token.rlike(rf"^{NAME}$") & (following == ":"), F.concat(F.lit('"'), token, F.lit('"')))
        .when(token.rlike(rf"^{NUMBER}$"), _number(token))
        .otherwise(token)
    )


def strict_json(text: Column) -> Column:
    """A JSON5 document as JSON on one line; null stays null, a document that is no JSON5 stays one that is no JSON.

    Infinite numbers and NaN become texts. A document's tokens are held together, about ten times its size.
    """

    def rewritten(tokens: Column) -> Column:
        # blanks and comments fall away first, so that the token after a name or a comma is the next one
        bare = F.filter(tokens, lambda t: ~t.rlike(rf"^(?:{COMMENT}|{SPACE})"))
        near = lambda b, i: F.coalesce(F.get(b, i), F.lit(""))
        return let(bare, lambda b: F.array_join(F.transform(b, lambda t, i: _joined(near(b, i - 1), t, near(b, i + 1))), ""))

    return F.when(text.isNotNull(), let(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), rewritten))


def _joined(before: Column, token: Column, following: Column) -> Column:
    """A token, with a blank after it where two words would become one; a comma between a value and a closing bracket is left out."""
    trailing = (token == ",") & following.isin("}", "]") & ~before.isin("", ",", "[", "{", ":")
    word = r"[\p{L}\p{Nd}$_.+\-]"
    apart = token.rlike(rf"{word}$") & following.rlike(rf"^{word}")
    return F.when(trailing, "").otherwise(F.concat(_token(token, following), F.when(apart, " ").otherwise("")))
