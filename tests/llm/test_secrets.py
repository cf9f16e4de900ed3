"""Secret scan against regular expressions of Python and a battery written anew."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from hashlib import sha256

import pyarrow.parquet as pq
from ledgerlake.llm.queries import op11_secrets
from ledgerlake.llm.secrets import ALPHABETS, find_secrets, rate_tokens, running_sums, secret_digests
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
KINDS = ["assign", "access", "hex", "random"]
COLUMNS = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]


def _base(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def _candidates(text):
    chars = list(text)
    for m in ASSIGN.finditer(text):
        chars[m.start() : m.end()] = " " * (m.end() - m.start())
    left = "".join(chars)
    for m in re.finditer(r"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", left):
        chars[m.start() : m.end()] = " " * (m.end() - m.start())
    return [(m.start(), m.end(), m[0]) for m in CANDIDATE.finditer("".join(chars))]


def _normal(z):
    return math.erfc(z / math.sqrt(2)) / 2


def _rate(token):
    body = token.rstrip("=")
    alphabet = next(a for a in ALPHABETS if set(body) <= set(a))
    n, k, seen = len(body), len(alphabet), Counter(body)
    chi = sum((seen[s] - n / k) ** 2 / (n / k) for s in alphabet)
    symbols = _normal(((chi / (k - 1)) ** (1 / 3) - 1 + 2 / (9 * (k - 1))) / math.sqrt(2 / (9 * (k - 1))))
    cells = [[s for s in alphabet if s.isupper()], [s for s in alphabet if s.islower()], [s for s in alphabet if not s.isalpha()]]
    cells = [c for c in cells if c]
    classes = sum((sum(seen[s] for s in c) - n * len(c) / k) ** 2 / (n * len(c) / k) for c in cells)
    by_class = math.exp(-classes / 2) if len(cells) == 3 else 2 * _normal(math.sqrt(classes))
    codes = [alphabet.index(c) for c in body]
    changes = sum((a < k // 2) != (b < k // 2) for a, b in zip(codes, codes[1:]))
    runs = 2 * _normal(abs(changes - (n - 1) / 2) / math.sqrt((n - 1) / 4))
    middle = (k - 1) / 2
    serial = 2 * _normal(abs(sum((a - middle) * (b - middle) for a, b in zip(codes, codes[1:]))) / ((k * k - 1) / 12 * math.sqrt(n - 1)))
    h = -sum(math.log(min(1, max(p, 1e-300))) for p in (2 * min(symbols, by_class), runs, serial))
    p = max(math.exp(-h) * (1 + h + h * h / 2), 1e-300)
    return math.floor(2 * math.log2(n)), min(3000, math.floor(-math.log10(p) * 100)), body


def _brute(texts, rate=0.05):
    found = [[(s, e, *_rate(w)) for s, e, w in _candidates(t or "")] for t in texts]
    tests = {(stratum, step, body) for row in found for _, _, stratum, step, body in row}
    first = {}
    for stratum in {t[0] for t in tests}:
        steps = sorted((t[1] for t in tests if t[0] == stratum), reverse=True)
        for rank, step in enumerate(steps, 1):
            if 10 ** (-step / 100) <= rate * steps[:rank].__len__() / len(steps) or 10 ** (-step / 100) <= rate * sum(s >= step for s in steps) / len(steps):
                first[stratum] = step
    out = []
    for text, row in zip(texts, found):
        added = [(s, 3, e) for s, e, stratum, step, _ in row if step < first.get(stratum, 3001)]
        out.append((_base(text or ""), added))
    return out


def _shown(spans):
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _expected(ids, texts):
    rows = []
    for i, (base, added) in zip(ids, _brute(texts)):
        counts = [sum(s[1] == k for s in base) for k in range(3)]
        rows.append((i, *counts, sha256(_shown(base).encode()).hexdigest(), _shown(sorted(base + added))))
    return Counter(rows)


def _random(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


def _texts():
    rng = random.Random(4)
    words = ["internationalization", "getElementsByTagNameNS", "some-long-identifier-name", "usr/local/lib/python/dist-packages", "THIS_IS_A_LONG_CONSTANT_NAME", "=" * 40, "-" * 90, "_" * 33]
    texts = [
        None, "", " ", 'password = "hunter22", PASSWD:abc, Token=abcdef', "password: token: abcdefgh", "api_key=api-key=x", "😀 secret : 'ünïcode' apikey=ABCDEFG.h",
        "AKIA" + "A1" * 8, "xAKIA" + "A1" * 8 + "b", "AKIAAKIA" + "B" * 11, "a" * 23 + " " + "a" * 24 + "g" + "0" * 30, "token=" + "0123456789abcdef" * 3, "deadbeef" * 6,
        "\n".join(f"token: value{i:05d}" for i in range(900)), "é" * 30 + "secret=" + "é" + " key token  =  \"abc.def-ghi\"", "secret=\nabcdefgh", "ſecret=abcdefgh toKen=abcdefgh",
    ]
    for alphabet in ALPHABETS:
        for n in (20, 32, 44, 64, 200):
            texts.append(f"see {_random(rng, alphabet, n)} here")
    texts += [f"{rng.choice(words)} is {rng.choice(words)}-{rng.choice(words)} {_random(rng, 'etaoinshrdlu', 24)}" for _ in range(120)]
    texts += ["key " + _random(rng, ALPHABETS[5], 40)] * 5 + ["x" * 300_000, _random(rng, ALPHABETS[6], 50_000) + "=="]
    return texts


def test_equals_brute_force(rows):
    texts = _texts()
    ids = [i if i % 9 else None for i in range(len(texts))]
    frame = rows("doc_id BIGINT, text STRING, id STRING, base INT, random INT", *[(i, t, "a", 1, 2) for i, t in zip(ids, texts)]).repartition(5)
    got = secret_digests(frame)
    assert got.columns == COLUMNS
    assert Counter(tuple(r) for r in got.collect()) == _expected(ids, texts)


def test_random_tokens_are_found_and_words_left_alone(rows):
    rng = random.Random(8)
    planted = [f"the value {_random(rng, ALPHABETS[5 + i % 3], rng.choice([24, 32, 40, 64]))} leaked" for i in range(300)]
    vocabulary = ["get", "set", "user", "Name", "value", "index", "Of", "list", "array", "Buffer", "stream", "Reader", "data", "base", "Table", "row", "2", "64"]
    clean = [f"call {''.join(rng.choice(vocabulary) for _ in range(9))} or {'_'.join(rng.choice(vocabulary) for _ in range(7))}" for _ in range(900)]
    frame = rows("doc_id BIGINT, text STRING", *enumerate(planted + clean)).repartition(4)
    flagged = {r["doc_id"] for r in find_secrets(frame).where("size(added) > 0").collect()}
    assert sum(i in flagged for i in range(300)) >= 275
    assert sum(i in flagged for i in range(300, 1200)) <= 18


def test_battery_equals_its_formulas(rows):
    rng = random.Random(2)
    tokens = [_random(rng, a[: rng.choice([3, len(a)])], rng.choice([20, 33, 64, 500])) for a in ALPHABETS for _ in range(12)]
    frame = rows("at INT, word STRING", *enumerate(tokens)).select("at", F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"), "word")).alias("c"))
    for row in rate_tokens(frame, "c").collect():
        stratum, step, _ = _rate(tokens[row["at"]])
        assert row["c"][0]["stratum"] == stratum and abs(row["c"][0]["step"] - step) <= 1


def test_running_sums(spark):
    for n in (0, 1, 255, 256, 257, 5000):
        got = spark.range(1).select(running_sums(F.transform(F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>"), lambda x: x.cast("long"))).alias("s")).first()["s"]
        assert got == [i * (i + 1) // 2 for i in range(1, n + 1)]


def test_whole_table_and_empty_table(spark, rows):
    folder = "/root/testdata/sf0.01"
    table = pq.read_table(f"{folder}/documents.parquet").to_pylist()
    got = op11_secrets(spark, folder)
    assert Counter(tuple(r) for r in got.collect()) == _expected([r["doc_id"] for r in table], [r["text"] for r in table])
    empty = secret_digests(rows("doc_id BIGINT, text STRING", (1, "a")).limit(0))
    assert empty.count() == 0 and empty.columns == COLUMNS


def test_native(spark):
    plan = op11_secrets(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
