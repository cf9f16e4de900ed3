"""Secrets in texts: fixed patterns, and runs of characters that a battery of randomness tests can't tell from random ones.

Everything is a column expression: no Python runs in the tasks. Places of matches come from the lengths of the matches and of the pieces
between them, summed in two levels so that very many matches cost little more than few.

The battery tests one token at a time against a uniform draw from the smallest alphabet that holds it: chi-squared for its symbols and for
its classes of characters (upper case, lower case, other), runs above and below the middle of the alphabet, and serial correlation. Fisher's
rule joins the three. Most candidates of ordinary text are rejected; how small a probability rejects one is set for each class of
lengths by Benjamini and Hochberg's rule over the distinct candidates of all rows, so that of the tokens thrown out at a length at most
a share ``rate`` is expected to be random. What is not thrown out is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlake.functions.binding import let
from ledgerlake.llm.common import has_columns, materialize

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are taken whole, so a least length in the pattern finds what a filter on the length would keep.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
LEAST_ASSIGNED = 6
KINDS = ["assign", "access", "hex", "random"]

#: A candidate of the battery has at least this many symbols.
LEAST_LENGTH = 20
RATE = 0.05
#: Probabilities are counted in steps of a hundredth of a power of ten, down to this many steps.
MOST_STEPS = 3000
#: Lengths summed together.
BLOCK = 256

_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: The alphabets from small to large; a token belongs to the first that has all its symbols.
ALPHABETS = [
    _DIGITS + "abcdef", _DIGITS + "ABCDEF", _UPPER + "234567", _LOWER + _DIGITS, _UPPER + _DIGITS, _UPPER + _LOWER + _DIGITS,
    _UPPER + _LOWER + _DIGITS + "+/", _UPPER + _LOWER + _DIGITS + "-_", _UPPER + _LOWER + _DIGITS + "+/-_",
]


def running_sums(lengths: Column) -> Column:
    """Sums of an array up to each place; blocks are summed apart, so the work is the array's length times ``BLOCK`` at most."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))

    def up_to(values: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<long>").alias("all"))
        step = lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.array_append(a["all"], a["sum"] + x).alias("all"))
        return F.aggregate(values, start, step, lambda a: a["all"])

    inside = F.transform(blocks, up_to)
    ends = up_to(F.transform(inside, lambda block: F.element_at(block, -1)))
    return F.when(F.size(lengths) == 0, F.array().cast("array<long>")).otherwise(
        F.flatten(F.zip_with(inside, ends, lambda block, end: F.transform(block, lambda x: x + end - F.element_at(block, -1))))
    )


def _long(column: Column) -> Column:
    return F.length(column).cast("long")


def _pieces(text: str, pattern: str, found: str) -> Column:
    """What lies between the matches; one more than there are matches."""
    return F.when(F.size(found) > 0, F.split(F.col(text), pattern, -1)).otherwise(F.array().cast("array<string>"))


def _spans(found: str, between: str) -> Column:
    """``start``, ``end`` (code points) and ``word`` of each match."""
    steps = F.zip_with(F.slice(F.col(between), F.lit(1), F.size(found)), F.concat(F.array(F.lit("")), F.col(found)), lambda gap, before: _long(gap) + _long(before))
    starts = running_sums(F.slice(steps, F.lit(1), F.size(found)))
    return F.zip_with(starts, F.col(found), lambda s, w: F.struct(s.alias("start"), (s + _long(w)).alias("end"), w.alias("word")))


def _blanked(found: str, between: str, text: str) -> Column:
    """The text with blanks in place of the matches."""
    parts = F.zip_with(F.col(between), F.col(found), lambda gap, word: F.concat(gap, F.coalesce(F.repeat(F.lit(" "), F.length(word)), F.lit(""))))
    return F.when(F.size(found) > 0, F.array_join(parts, "")).otherwise(F.col(text))


def locate(df: DataFrame, text: str, pattern: str, name: str) -> DataFrame:
    """Adds ``name``, the spans of all matches, and ``name_blanked``, the text without them."""
    df = df.withColumn(f"{name}_found", F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    df = df.withColumn(f"{name}_between", _pieces(text, pattern, f"{name}_found"))
    blanked = _blanked(f"{name}_found", f"{name}_between", text)
    return df.withColumns({name: _spans(f"{name}_found", f"{name}_between"), f"{name}_blanked": blanked}).drop(f"{name}_found", f"{name}_between")


# ---------------------------------------------------------------- the battery


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution (Abramowitz and Stegun 26.2.17)."""

    def upper(size: Column, t: Column) -> Column:
        series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.exp(-size * size / 2) * 0.3989422804014327 * series

    def tail(z: Column) -> Column:
        above = let(F.abs(z), lambda size: let(1 / (1 + 0.2316419 * size), lambda t: upper(size, t)))
        return F.when(z >= 0, above).otherwise(1 - above)

    return let(z, tail)


def _within(p: Column) -> Column:
    return F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-300))


def _by_alphabet(kind: Column, values: list) -> Column:
    """A number or text of each alphabet."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), kind)


def _class_probability(c: Column) -> Column:
    """Chi-squared of upper case, lower case and other symbols; alphabets have two or three of them."""
    total = F.lit(0.0)
    for number, symbols in enumerate((_UPPER, _LOWER)):
        shares = [sum(s in symbols for s in a) / len(a) for a in ALPHABETS]
        seen = c["n"] - F.length(F.translate(c["body"], symbols, ""))
        expected = c["n"] * _by_alphabet(c["kind"], shares)
        total = total + F.when(expected > 0, (seen - expected) * (seen - expected) / F.greatest(expected, F.lit(1e-9))).otherwise(0.0)
    others = [sum(s not in _UPPER + _LOWER for s in a) / len(a) for a in ALPHABETS]
    expected = c["n"] * _by_alphabet(c["kind"], others)
    seen = F.length(F.translate(c["body"], _UPPER + _LOWER, ""))
    total = total + (seen - expected) * (seen - expected) / expected
    three = [len({s.isupper() - s.islower() for s in a}) == 3 for a in ALPHABETS]
    return F.when(_by_alphabet(c["kind"], three), F.exp(-total / 2)).otherwise(2 * _tail(F.sqrt(total)))


def _symbol_probability(c: Column) -> Column:
    """Chi-squared of all symbols of the alphabet, as a normal deviate by Wilson and Hilferty."""
    k = F.length(c["alphabet"]).cast("double")
    squares = F.aggregate(
        F.split(c["alphabet"], ""), F.lit(0.0), lambda a, s: a + F.pow((c["n"] - F.length(F.replace(c["body"], s, F.lit("")))).cast("double"), F.lit(2.0))
    )
    chi = F.greatest(k * squares / c["n"] - c["n"], F.lit(0.0))
    spread = 2 / (9 * (k - 1))
    return _tail((F.pow(chi / (k - 1), F.lit(1 / 3)) - 1 + spread) / F.sqrt(spread))


def _runs_probability(c: Column) -> Column:
    """Changes between the halves of the alphabet: each step changes with probability one half."""
    halves = _by_alphabet(c["kind"], ["0" * (len(a) // 2) + "1" * (len(a) // 2) for a in ALPHABETS])
    changes = F.length(F.regexp_replace(F.call_function("translate", c["body"], c["alphabet"], halves), "0+|1+", "x")) - 1
    return 2 * _tail(F.abs(changes - (c["n"] - 1) / 2) / F.sqrt((c["n"] - 1) / 4))


def _serial_probability(c: Column) -> Column:
    """Products of neighbouring symbols' places, less the mean of the alphabet."""
    k = F.length(c["alphabet"]).cast("double")
    products = F.zip_with(F.slice(c["codes"], F.lit(1), c["n"] - 1), F.slice(c["codes"], F.lit(2), c["n"] - 1), lambda a, b: (a - (k + 1) / 2) * (b - (k + 1) / 2))
    total = F.aggregate(products, F.lit(0.0), lambda a, x: a + x)
    return 2 * _tail(F.abs(total) / ((k * k - 1) / 12 * F.sqrt((c["n"] - 1).cast("double"))))


def _more(c: Column, known: list[str], **new: Column) -> Column:
    return F.struct(*[c[k].alias(k) for k in known], *[v.alias(k) for k, v in new.items()])


def rate_tokens(df: DataFrame, name: str) -> DataFrame:
    """Spans of candidates get ``stratum`` (two to a doubling of the length), ``step`` (how improbable a random draw is) and ``key``."""
    place, known = ["start", "end"], ["start", "end", "body", "n"]
    df = df.withColumn(name, F.transform(name, lambda c: _more(c, place, body=F.rtrim(c["word"], F.lit("=")), n=F.length(F.rtrim(c["word"], F.lit("="))))))
    kind = lambda c: F.coalesce(*[F.when(F.length(F.translate(c["body"], a, "")) == 0, F.lit(i)) for i, a in enumerate(ALPHABETS, 1)])
    df = df.withColumn(name, F.transform(name, lambda c: _more(c, known, kind=kind(c))))
    df = df.withColumn(name, F.transform(name, lambda c: _more(c, [*known, "kind"], alphabet=_by_alphabet(c["kind"], ALPHABETS))))
    codes = lambda c: F.transform(F.split(c["body"], ""), lambda s: F.call_function("locate", s, c["alphabet"]))
    df = df.withColumn(name, F.transform(name, lambda c: _more(c, [*known, "kind", "alphabet"], codes=codes(c))))
    df = df.withColumn(
        name,
        F.transform(name, lambda c: _more(
            c, known, uniform=_within(2 * F.least(_symbol_probability(c), _class_probability(c))), runs=_within(_runs_probability(c)), serial=_within(_serial_probability(c)),
        )),
    )
    df = df.withColumn(name, F.transform(name, lambda c: _more(c, known, h=-(F.log(c["uniform"]) + F.log(c["runs"]) + F.log(c["serial"])))))
    step = lambda c: F.least(F.floor(-F.log10(_within(F.exp(-c["h"]) * (1 + c["h"] + c["h"] * c["h"] / 2))) * 100), F.lit(MOST_STEPS)).cast("int")
    stratum = lambda c: F.floor(2 * F.log2(c["n"].cast("double"))).cast("int")
    return df.withColumn(name, F.transform(name, lambda c: _more(c, place, stratum=stratum(c), step=step(c), key=F.xxhash64(c["body"]))))


def least_rejected(rated: DataFrame, name: str, rate: float = RATE) -> dict[int, int]:
    """The first step that is rejected, for each class of lengths that rejects any.

    Repeats of a token count once, however many rows hold it. One row per class and step is left before the rule is applied.
    """
    tokens = rated.select(F.explode(name).alias("c")).select("c.stratum", "c.step", "c.key").distinct()
    steps = tokens.groupBy("stratum", "step").agg(F.count(F.lit(1)).alias("n"))
    of_class = Window.partitionBy("stratum")
    down = of_class.orderBy(F.desc("step"))
    ranked = steps.select("stratum", "step", F.sum("n").over(down).alias("rank"), F.sum("n").over(of_class).alias("tests"))
    rejected = ranked.where(F.pow(F.lit(10.0), -F.col("step") / 100) <= rate * F.col("rank") / F.col("tests"))
    return {r[0]: r[1] for r in rejected.groupBy("stratum").agg(F.min("step")).collect()}


# ---------------------------------------------------------------- the scan


def find_secrets(df: DataFrame, text: str = "text", id_column: str = "doc_id", rate: float = RATE) -> DataFrame:
    """Per row: id, ``base`` and ``added`` spans as arrays of (``start``, ``kind`` number, ``end``), in code points, sorted.

    Candidates of the battery are the runs of at least ``LEAST_LENGTH`` base64 symbols that are left when the matches of the fixed patterns
    are blanked. Texts are scanned once; places and test results are written under the shared folder. A null or empty text
    has no spans; ids may be null or repeated and every row is kept; an empty table gives no row. Other columns, whatever their names,
    are left out.
    """
    has_columns(df, id_column, text)
    rows = df.select(F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = locate(rows, "text", ASSIGN, "assign")
    rows = rows.withColumn("assign", F.filter("assign", lambda s: F.length(F.regexp_extract(s["word"], ASSIGN, 2)) >= LEAST_ASSIGNED))
    rows = locate(rows, "text", ACCESS, "access").drop("access_blanked")
    rows = locate(rows, "text", HEX, "hex").drop("hex_blanked")
    rows = locate(rows, "assign_blanked", f"{HEX}|{ACCESS}", "known").drop("known")
    rows = locate(rows, "known_blanked", f"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST_LENGTH},}}={{0,2}}", "random")
    base = F.concat(*[_numbered(F.col(kind), n) for n, kind in enumerate(KINDS[:3])])
    rows = rows.select("id", F.sort_array(base).alias("base"), "random")
    rated = materialize(rate_tokens(rows, "random"), "secrets-rated")
    first = least_rejected(rated, "random", rate)
    limits = F.create_map(*[F.lit(v) for pair in first.items() for v in pair]) if first else F.create_map(F.lit(-1), F.lit(0))
    kept = F.filter("random", lambda c: c["step"] < F.coalesce(F.try_element_at(limits, c["stratum"]), F.lit(MOST_STEPS + 1)))
    return rated.select(F.col("id").alias(id_column), "base", _numbered(kept, 3).alias("added"))


def _numbered(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digests(df: DataFrame, text: str = "text", id_column: str = "doc_id", rate: float = RATE) -> DataFrame:
    """Per row: id, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans``; as :func:`find_secrets`."""
    count = lambda n: F.size(F.filter("base", lambda s: s["kind"] == n)).cast("long")
    return find_secrets(df, text, id_column, rate).select(
        F.col(f"`{id_column}`"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.sort_array(F.concat("base", "added"))).alias("spans"),
    )
