"""Every registered query against its SQL, and properties all of them must have."""

from __future__ import annotations

import inspect
import os
import re
from importlib import import_module

import pytest
from oracle import connect, difference

from ledgerlake import plans
from ledgerlake.plans import all_queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LARGER = "/root/testdata/sf0.01"
QUERIES = all_queries()
SURVEY_ROWS = {
    "S": 9, "P": 10, "J": 13, "A": 15, "W": 9, "O": 7, "U": 3, "F": 17, "L": 9, "M": 13, "C": 3, "X": 8, "D": 3,
}
SURVEY_IDS = [f"{group}{n}" for group, rows in SURVEY_ROWS.items() for n in range(1, rows + 1)]


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_equals_sql(spark, duck, name):
    message = difference(spark, duck, QUERIES[name], FOLDER)
    if message == "no rows":  # equal, but too few rows to tell anything
        message = difference(spark, connect(LARGER), QUERIES[name], LARGER)
    assert message is None, message


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.sql])
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def _source_of(plan, helpers) -> str:
    """Source of a plan and of the helpers in the plans package that it uses."""
    seen, waiting, text = set(), [plan], ""
    while waiting:
        function = waiting.pop()
        if function not in seen:
            seen.add(function)
            source = inspect.getsource(function)
            text += source
            waiting += [helpers[name] for name in re.findall(r"\w+", source) if name in helpers]
    return text


def test_every_survey_row_has_a_query_that_calls_its_operator():
    modules = [import_module(f"ledgerlake.plans.{name}") for name in (*plans.MODULES, "roles")]
    modules += [import_module(f"ledgerlake.functions.{name}") for name in ("events", "naming", "scalar")]
    helpers = {n: f for m in modules for n, f in vars(m).items() if inspect.isfunction(f) and f.__module__.startswith(("ledgerlake.plans", "ledgerlake.functions"))}
    lines = (os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "COVERAGE.md")
    with open(os.path.join(*lines), encoding="utf-8") as file:
        table = [[cell.strip() for cell in line.strip().strip("|").split("|")] for line in file]
    rows = {r[0]: r for r in table if len(r) == 3 and re.fullmatch(r"[A-Z]\d+", r[0])}
    assert [i for i in SURVEY_IDS if i not in rows] == []
    for row, operators, names in rows.values():
        names = [n.strip() for n in names.split(",")]
        assert set(names) <= set(QUERIES), row
        text = "".join(_source_of(QUERIES[n].plan, helpers) for n in names)
        called = [o for o in re.findall(r"`[\w.]*?(\w+)(?:\(.*?\))?`", operators) if re.search(rf"\b{o}\b", text)]
        assert called or "built-ins" in operators, row


def test_contract(spark):
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).limit(1).count() == 1
    assert set(QUERIES) <= set(contract.queries())
