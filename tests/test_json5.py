"""JSON5 documents, form by form."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from ledgerlake.functions.json5 import strict_json
from ledgerlake.sources import seeds

FORMS = {
    # numbers
    "0x1F": 31, "-0xff": -255, "+0X0a": 10, ".5": 0.5, "-.5e1": -5.0, "5.": 5, "5.e2": 500.0, "+1": 1, "+1.25E+2": 125.0, "0": 0, "-0.0": -0.0, "1e3": 1000.0, "123": 123,
    "NaN": "NaN", "-NaN": "NaN", "Infinity": "Infinity", "+Infinity": "Infinity", "-Infinity": "-Infinity", "0xFFFFFFFFFFFFFFFF": 18446744073709551615,
    # strings
    '"a"': "a", "'a'": "a", "'it\\'s \"so\"'": "it's \"so\"", '"\\x41\\u0042\\v\\0"': "AB\x0b\x00", "'a\\\nb\\\r\nc'": "abc", '"\\a\\q\\\\\\/"': "aq\\/", '"a\tb"': "a\tb",
    "'// no comment, /* none */ ,}'": "// no comment, /* none */ ,}", '"\\\\"': "\\", "'\\\\\\''": "\\'", '"é\\u00e9日"': "éé日", "''": "", '"\\n\\t\\b\\f\\r"': "\n\t\b\f\r", "'{a: 1}'": "{a: 1}",
    # literals and containers
    "true": True, "false": False, "null": None, "[]": [], "{}": {}, "[1,]": [1], "{a: 1,}": {"a": 1}, "[ [ 1 , ] , ]": [[1]], "{ $x_1: 'y', \"z z\": .1 }": {"$x_1": "y", "z z": 0.1},
    "{null: 1, true: 2, Infinity: 3, NaN: 4, e5: 5}": {"null": 1, "true": 2, "Infinity": 3, "NaN": 4, "e5": 5}, "{ünï: 1, \\u0061b: 2}": {"ünï": 1, "ab": 2}, "{a /* k */ : /* v */ 1 // end\n}": {"a": 1},
    "/* ** / */ [1 // x\n, 2]": [1, 2], "\ufeff\u00a0[1]\u2028": [1], "{a:{b:[{c:0x10}]}}": {"a": {"b": [{"c": 16}]}}, "[+1,-2,+.5]": [1, -2, 0.5], "// only\n1": 1, "[1 /* a */ /* b */ , /* c */]": [1],
}
BROKEN = ["{a 1}", "[1 2]", "{a: 'x}", "[1", "{'a': 01x}", "{a:: 1}", "[,]", "nonsense", "'a' 'b'", "tr ue", "1 2", "- 1"]


def _strict(rows, texts):
    frame = rows("at INT, value STRING", *enumerate(texts))
    return [r["s"] for r in frame.select("at", strict_json(F.col("value")).alias("s")).orderBy("at").collect()]


def test_every_form(rows):
    made = _strict(rows, list(FORMS))
    for text, got in zip(FORMS, made):
        assert json.loads(got) == FORMS[text], (text, got)
        assert "\n" not in got


def test_what_is_no_json5_stays_unreadable(rows):
    for text, got in zip(BROKEN, _strict(rows, BROKEN)):
        with pytest.raises(ValueError):
            json.loads(got)
            raise AssertionError((text, got))
    assert _strict(rows, [None, "", "// nothing"]) == [None, "", ""]


def test_strict_documents_keep_their_value(rows):
    documents = [{"a": [1, 2.5, None, True], "b c": {"d": 'q"\\/\n\tü'}}, [[], {}], "x", 1e300, {"": 0}]
    assert [json.loads(s) for s in _strict(rows, [json.dumps(d) for d in documents])] == documents
    assert [json.loads(s) for s in _strict(rows, [json.dumps(d, indent=2, ensure_ascii=False) for d in documents])] == documents


@pytest.mark.parametrize("per_line", [False, True])
def test_seed_files(spark, tmp_path, per_line):
    folder = tmp_path / "seeds"
    folder.mkdir()
    texts = ["{a: 0x10, b: .5, c: 'it\\'s', d: [+1, 2.],}", "// a comment", "[{a: -1, b: 5., c: null}, {a: 7, e: {f: true}}]"]
    if per_line:
        (folder / "all.json5").write_text("\n".join(texts) + "\n\n")
    else:
        for i, text in enumerate(texts):
            (folder / f"{i}.json5").write_text(text.replace(",", ",\n"))
    got = sorted((r.asDict(True) for r in seeds.read_json_seed(spark, str(folder), per_line=per_line).collect()), key=lambda r: r["a"])
    assert got == [
        {"a": -1, "b": 5.0, "c": None, "d": None, "e": None}, {"a": 7, "b": None, "c": None, "d": None, "e": {"f": True}}, {"a": 16, "b": 0.5, "c": "it's", "d": [1, 2], "e": None},
    ]
    typed = seeds.read_json_seed(spark, str(folder), "a INT, b DOUBLE", per_line=per_line)
    assert sorted((r.a, r.b) for r in typed.where("b IS NOT NULL").collect()) == [(-1, 5.0), (16, 0.5)]


def test_numbers_that_json_lacks_and_unreadable_documents(spark, tmp_path):
    path = tmp_path / "x.json5"
    path.write_text("{a: NaN}\n{a: -Infinity}\n{a: +1.5}\n{a 1}\n[]\n")
    got = [r.a for r in seeds.read_json_seed(spark, str(path), "a DOUBLE", per_line=True).collect()]
    assert str(got[0]) == "nan" and got[1:] == [float("-inf"), 1.5, None]
    empty = tmp_path / "empty.json5"
    empty.write_text("// nothing\n[]\n")
    assert seeds.read_json_seed(spark, str(empty), per_line=True).count() == 0


def test_no_python_in_the_plan(spark, tmp_path):
    path = tmp_path / "x.json5"
    path.write_text("{a: 1}\n")
    assert "Python" not in seeds.read_json_seed(spark, str(path), per_line=True)._jdf.queryExecution().toString()
