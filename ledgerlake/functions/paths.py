"""Path-prefix tests. A prefix matches the path itself or a path below it."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def relative_to(path: Column, base: str) -> Column:
    prefix = base.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(prefix)), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)


def under(path: Column, prefix: str) -> Column:
    plain = prefix.replace("\\", "/")
    return (path == plain) | F.startswith(path, F.lit(plain + "/"))


def under_any(path: Column, prefixes: Iterable[str]) -> Column:
    tests = [under(path, p) for p in prefixes]
    return reduce(or_, tests) if tests else F.lit(False)


def ancestors(path: Column) -> Column:
    """The path and every prefix of it that ends before a separator: ``a/b/c`` → a, a/b, a/b/c."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
