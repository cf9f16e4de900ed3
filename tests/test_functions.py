from __future__ import annotations

from datetime import date

import pytest
from conftest import cells
from pyspark.sql import functions as F

from ledgerlake.functions import events, masking, naming, paths, scalar


def evaluate(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "value, expected",
    [("a@b.c", True), ("a@b", False), ("a.b@c", False), ("ab.c", False), (None, False), ("@.", True), ("", False)],
)
def test_is_email(spark, value, expected):
    assert evaluate(spark, scalar.is_email, value) is expected


@pytest.mark.parametrize("value, expected", [("#12aBcD", True), ("#12aBcG", False), ("12aBcD", False), (None, True), ("#123", False)])
def test_is_hex_color(spark, value, expected):
    assert evaluate(spark, scalar.is_hex_color, value) is expected


@pytest.mark.parametrize("value, expected", [(0, "None"), (3, "High"), (4, "Unknown"), (None, "Unknown")])
def test_priority_label(spark, value, expected):
    assert evaluate(spark, scalar.priority_label, value, "int") == expected


@pytest.mark.parametrize(
    "value, expected",
    [(0, "0"), (999, "999"), (1000, "1.0K"), (1250, "1.3K"), (1500, "1.5K"), (185350, "185.3K"), (1750, "1.8K"), (2_300_000, "2.3M")],
)
def test_compact_number(spark, value, expected):
    assert evaluate(spark, scalar.compact_number, value, "bigint") == expected


@pytest.mark.parametrize(
    "value, expected",
    [("10mb", 10485760), ("1gb", 1073741824), ("512KB", 524288), ("1.5 kb", 1536), ("7", 7), ("7b", 7), ("x", None), ("5tb", None), (None, None)],
)
def test_size_bytes(spark, value, expected):
    assert evaluate(spark, scalar.size_bytes, value) == expected


def test_quote_pad_and_length(spark):
    assert evaluate(spark, scalar.sql_quote, "O'Brien") == "'O''Brien'"
    assert evaluate(spark, scalar.sql_quote, None) == "NULL"
    assert evaluate(spark, scalar.sql_quote, True, "boolean") == "'true'"
    assert evaluate(spark, scalar.pad_id, 1, "bigint") == "000001"
    assert evaluate(spark, scalar.pad_id, 12345678, "bigint") == "12345678"
    assert evaluate(spark, scalar.trimmed_length, "ab  ") == 2


def test_identity_hash_needs_every_field(rows):
    import hashlib

    df = rows("a string, b string, c string, d string", ("e", "n", "m", "o"), ("e", "", "m", "o"), ("e", None, "m", "o"))
    got = [r[0] for r in df.select(scalar.identity_hash(*[F.col(c) for c in "abcd"])).collect()]
    assert got == [hashlib.sha256(b"e\0n\0m\0o").hexdigest(), None, None]
    with pytest.raises(Exception, match="identity hash needs"):
        df.select(scalar.require_identity_hash(*[F.col(c) for c in "abcd"])).collect()


def test_row_json_keeps_nulls(rows):
    df = rows("a int, b string", (1, None))
    assert df.select(scalar.row_json(df)).first()[0] == '{"a":1,"b":null}'


def test_day_difference_counts_boundaries(rows):
    df = rows("a string, b string", ("2024-01-02 00:01:00", "2024-01-01 23:59:00"))
    assert df.select(scalar.day_difference(F.col("a").cast("timestamp"), F.col("b").cast("timestamp"))).first()[0] == 1


@pytest.mark.parametrize(
    "name, when, text",
    [("2024-01-15-add-users", date(2024, 1, 15), "add-users"), ("2024-13-01-x", None, "2024-13-01-x"), ("init", None, "init"), ("2024-01-15", None, "2024-01-15")],
)
def test_change_names(spark, name, when, text):
    assert evaluate(spark, naming.change_date, name) == when
    assert evaluate(spark, naming.change_description, name) == text


@pytest.mark.parametrize(
    "name, number, text",
    [("001_create-users.sql", 1, "create-users"), ("010_x.sql.tmpl", 10, "x"), ("002_refs.txt", 2, "refs"), ("invalid.sql", None, "invalid"), ("1_x.sql", None, "1_x")],
)
def test_file_names(spark, name, number, text):
    assert evaluate(spark, naming.file_sequence, name) == number
    assert evaluate(spark, naming.file_description, name) == text


@pytest.mark.parametrize(
    "name, key",
    [("my-config.json5", "myConfig"), ("seed_data.yml", "seedData"), ("API_KEYS.json", "apiKeys"), ("users.csv", "users"), ("a/b/asc.fasb.org.yaml", "ascFasbOrg"), (".env", "env"), ("XMLHttp2x.js", "xmlHttp2X")],
)
def test_context_key(spark, name, key):
    assert evaluate(spark, naming.context_key, name) == key


def test_paths(spark):
    assert evaluate(spark, lambda c: paths.under(c, "a/b"), "a/b/c.sql") is True
    assert evaluate(spark, lambda c: paths.under(c, "a/b"), "a/bc.sql") is False
    assert evaluate(spark, paths.ancestors, "a/b/c") == ["a", "a/b", "a/b/c"]
    assert evaluate(spark, lambda c: paths.relative_to(c, "/x"), "/x/a/b") == "a/b"


@pytest.mark.parametrize(
    "event, level",
    [("error", "error"), ("db:error", "error"), ("x:failed", "error"), ("a:warning", "warn"), ("lock:blocked", "warn"), ("build:start", "info"), ("file:dry-run", "info"), ("file:before", "debug"), ("errors", "debug"), ("start", "debug")],
)
def test_classify(spark, event, level):
    assert evaluate(spark, events.classify_event, event) == level


def test_should_log(spark):
    keep = lambda level, event: evaluate(spark, lambda c: events.should_log(c, level), event)
    assert [keep(level, "build:start") for level in ("silent", "error", "warn", "info", "verbose")] == [False, False, False, True, True]
    assert keep("verbose", "file:before") and not keep("info", "file:before")


@pytest.mark.parametrize("status, level", [("success", "info"), ("skipped", "info"), ("failed", "error"), (None, "error")])
def test_entry_level(spark, status, level):
    assert evaluate(spark, lambda c: events.entry_level(F.lit("build:complete"), c), status) == level


@pytest.mark.parametrize(
    "event, data, message",
    [
        ("file:after", '{"status":"success","filepath":"a","durationMs":3}', "Executed a (3ms)"),
        ("file:after", '{"filepath":"a"}', "Failed a: undefined"),
        ("change:start", '{"direction":"change","name":"n"}', "Starting change for n (0 files)"),
        ("change:start", '{"direction":"change","name":"n","files":[1,2]}', "Starting change for n (2 files)"),
        ("config:updated", '{"name":"n","fields":["a","b"]}', "Updated config n: a, b"),
        ("config:activated", '{"name":"n","previous":"p"}', "Activated config: n (was p)"),
        ("config:activated", '{"name":"n","previous":""}', "Activated config: n"),
        ("settings:initialized", '{"path":"p","force":true}', "Settings initialized at p (forced)"),
        ("settings:initialized", '{"path":"p","force":false}', "Settings initialized at p"),
        ("logger:error", '{"error":{"message":"m"}}', "Logger error: m"),
        ("logger:error", '{"error":"plain"}', "Logger error: plain"),
        ("error", '{"source":"s","error":null}', "Error in s: Unknown error"),
        ("error", '{"source":"s","error":"text"}', "Error in s: text"),
        ("error", '{"source":"s","error":{"message":"m"}}', "Error in s: m"),
        ("error", '{"source":"s","error":{"code":"1","severity":"E","routine":"r","where":"w"}}', "Error in s: E 1 in r - w"),
        ("error", '{"source":"s","error":{"a":"zz","b":[1],"c":2,"d":3}}', 'Error in s: {a: "zz", b: [...], c: 2}'),
        ("x:y", '{"b":"x","a":1.5,"c":[1,2],"d":1}', 'x y: b="x", a=1.5, c=[2 items]'),
        ("x:y", '{"o":{"p":1},"n":null}', "x y: o={1 keys}, n=null"),
        ("x:y:z", "{}", "x y z"),
        ("x:y", None, "x y"),
    ],
)
def test_messages(rows, event, data, message):
    df = rows("e string, d string", (event, data))
    assert df.select(events.event_message(F.col("e"), F.col("d"))).first()[0] == message


@pytest.mark.parametrize(
    "value, plain, verbose",
    [
        ("", "<Password  (0) />", "<Password  (0) />"),
        ("a", "<Password * (1) />", "<Password * (1) />"),
        ("abcd", "<Password **** (4) />", "<Password a*** (4) />"),
        ("abcdefghijkl", "<Password ************ (12) />", "<Password abc********* (12) />"),
        ("mysecretpassword", "<Password ************... (16) />", "<Password myse********... (16) />"),
    ],
)
def test_mask_value(spark, value, plain, verbose):
    assert evaluate(spark, lambda c: masking.mask_value(c, F.lit("password")), value) == plain
    assert evaluate(spark, lambda c: masking.mask_value(c, F.lit("password"), verbose=True), value) == verbose


def test_spellings():
    assert {"api_key", "API_KEY", "apiKey", "api-key", "ApiKey", "apikey", "APIKEY"} <= masking.spellings("api_key")
    assert "APP_TOKEN" in masking.secret_keys(prefix="app") and "myField" in masking.secret_keys(extra=["my_field"])
    assert "username" not in masking.secret_keys()


@pytest.mark.parametrize(
    "data, expected",
    [
        ('{"password":"abc","user":"x"}', '{"password":"<Password *** (3) />","user":"x"}'),
        ('{ "token" : "ab" }', '{ "token" : "<Token ** (2) />" }'),
        ('{"a":{"b":[{"apiKey":"x"},["y"]]}}', '{"a":{"b":[{"apiKey":"<ApiKey * (1) />"},["y"]]}}'),
        ('{"token":5,"key":null,"secret":{"x":1}}', '{"token":5,"key":null,"secret":{"x":1}}'),
        ('{"x":"\\"password\\":\\"v","keys":"k"}', '{"x":"\\"password\\":\\"v","keys":"k"}'),
        ('{"pass":"q\\"\\u00e9"}', '{"pass":"<Pass *** (3) />"}'),
        ('"password"', '"password"'),
        ('{"pass\\u0077ord":"hunter2"}', '{"pass\\u0077ord":"<Password ******* (7) />"}'),
        ('[{"a":[{"\\u0074oken" : "x\\\\"}]}]', '[{"a":[{"\\u0074oken" : "<Token ** (2) />"}]}]'),
        ('{"\\u0070ath":"x"}', '{"\\u0070ath":"x"}'),
        ("{}", "{}"),
        (None, None),
    ],
)
def test_redact_json(spark, data, expected):
    assert evaluate(spark, lambda c: masking.redact_json(c, masking.secret_keys()), data) == expected


def test_redact_long_values(spark):
    """Long strings and many escapes neither overflow the matcher nor lose text."""
    data = '{"note":"' + "\\n" * 50_000 + '","password":"' + "s" * 100_000 + '"}'
    got = evaluate(spark, lambda c: masking.redact_json(c, masking.secret_keys()), data)
    assert got == '{"note":"' + "\\n" * 50_000 + '","password":"<Password ************... (100000) />"}'
