from __future__ import annotations

import random

from conftest import cells

from ledgerlake.operators import corpus
from ledgerlake.sources import corpus_files


def test_filter_paths(rows):
    files = rows("path string", ("/p/sql/tables/a.sql",), ("/p/sql/views/b.sql",), ("/p/sql/archive/c.sql",), ("/p/sql/tables2/d.sql",))
    keep = lambda *args: [r[0] for r in cells(corpus.filter_paths(files, *args, base="/p"))]
    assert keep(["sql/tables"]) == ["/p/sql/tables/a.sql"]
    assert keep(["sql\\tables"]) == ["/p/sql/tables/a.sql"]
    assert len(keep([], ["sql/archive"])) == 3
    assert keep(["sql"], ["sql/tables", "sql/archive"]) == ["/p/sql/tables2/d.sql", "/p/sql/views/b.sql"]
    assert keep(["sql/tables/a.sql"], ["sql/tables/a.sql"]) == []


def test_rule_table_equals_prefix_test(rows):
    """A table of rules gives what testing every rule against every path gives."""
    pick = random.Random(7)
    names = ["a", "b", "c", "ab"]
    paths = ["/".join(pick.choice(names) for _ in range(pick.randint(1, 4))) for _ in range(300)]
    files = rows("id int, path string", *list(enumerate(paths)))
    for size in (0, 1, 8, 25):
        rules = [("/".join(pick.choice(names) for _ in range(pick.randint(1, 3))), pick.choice(["include", "exclude"])) for _ in range(size)]
        include = [p for p, a in rules if a == "include"]
        exclude = [p for p, a in rules if a == "exclude"]
        table = rows("prefix string, action string", *rules)
        assert cells(corpus.filter_paths_by_rules(files, table)) == cells(corpus.filter_paths(files, include, exclude))


def test_ordered_rules(rows):
    rules = rows(
        "seq int, include array<string>, exclude array<string>",
        (1, ["a", "b"], ["c"]), (2, ["c"], ["a"]), (3, ["d"], ["d"]), (4, [], []),
    )
    evaluated = corpus.evaluate_rules(rules)
    assert cells(evaluated) == [("a", "exclude"), ("b", "include"), ("c", "include"), ("d", "exclude")]
    base = rows("prefix string, action string", ("a", "include"), ("x", "include"), ("x", "exclude"), ("y", "include"))
    merged = dict(cells(corpus.merge_base_rules(base, evaluated)))
    assert merged == {"a": "exclude", "b": "include", "c": "include", "d": "exclude", "x": "exclude", "y": "include"}


def test_matching_rules(rows):
    rules = rows("seq int, match_name string, match_test boolean", (1, "dev", None), (2, None, True), (3, "dev", False), (4, None, None))
    assert cells(corpus.matching_rules(rules, {"name": "dev", "test": True}), "seq") == [(1,), (2,), (4,)]
    assert cells(corpus.matching_rules(rules, {"name": "prod"}), "seq") == [(4,)]


def test_manifests(rows):
    manifests = rows("manifest string, content string", ("m1", "# head\n  b.sql \r\n\na.sql\n"), ("m2", "\n# only\n"), ("m3", "gone.sql"))
    assert cells(corpus.manifest_paths(manifests)) == [("m1", "a.sql"), ("m1", "b.sql"), ("m3", "gone.sql")]
    files = rows("path string", ("a.sql",), ("b.sql",))
    assert cells(corpus.manifest_errors(manifests, files)) == [("m2", None, "empty"), ("m3", "gone.sql", "missing")]


def test_name_reports(rows):
    files = rows("folder string, filename string", ("x", "001_a.sql"), ("x", "001_b.sql"), ("x", "002_c.sql"), ("y", "001_a.sql"), ("y", "n.sql"))
    assert cells(corpus.duplicate_sequences(files, ["folder"])) == [("x", 1, 2)]
    named = rows("filename string", ("asc_fasb.json",), ("asc.fasb.yaml",), ("other.csv",), ("other.csv",))
    assert cells(corpus.key_collisions(named)) == [("ascFasb", 2)]
    assert cells(corpus.parsed_names(rows("name string", ("2024-01-15-x",))), "description") == [("x",)]


def test_reading_files(spark, tmp_path):
    for name, text in {"b/2.sql": "SELECT 2", "a/1.sql.tmpl": "SELECT\n1", "a/x.md": "no", "a b%/r+s.sql": "é", "refs.txt": "a/1.sql.tmpl\n# c\n"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    scripts = corpus.fingerprinted(corpus_files.read_scripts(spark, str(tmp_path)))
    got = [(r.path.removeprefix(f"{tmp_path}/"), r.content) for r in scripts.collect()]
    assert sorted(got) == [("a b%/r+s.sql", "é"), ("a/1.sql.tmpl", "SELECT\n1"), ("b/2.sql", "SELECT 2")]
    manifests = corpus_files.read_manifests(spark, str(tmp_path))
    assert [r.path for r in corpus.manifest_paths(manifests).collect()] == ["a/1.sql.tmpl"]
