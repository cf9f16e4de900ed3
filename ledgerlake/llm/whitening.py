"""Whitening by the exact characteristic polynomial of the integer scatter matrix.

Entries become integers, so the scatter ``n * sum(x x') - S S'`` of the distinct vectors is an integer matrix, summed exactly by Spark.
Its characteristic polynomial is computed modulo many primes (Hessenberg form, then a recurrence), in tasks, and put together by
Chinese remaindering. All its roots are real, so the sign changes of a Taylor shift count the roots above a point exactly: that isolates the
largest ones, and bisection refines them to many more bits than a double has. Inverse iteration in fixed-point integers gives the null
vector of the matrix less a root, which is a component.

Only matrices and polynomials of the vectors' dimension reach the driver; their size does not depend on the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import has_columns, map_batches, materialize

#: Entries are multiplied by this and rounded down.
SCALE = 256
#: Rounded entries from here on raise an error.
MOST = 2**31
#: Bits to which a root is known, relative to itself, and of the fixed-point numbers of the inverse iteration.
ROOT_BITS = 200
FIXED_BITS = 640
#: Rows multiplied together.
BLOCK = 4096


# ---------------------------------------------------------------- integers and polynomials


def primes_below(top: int, product: int) -> list[int]:
    """The largest odd primes below ``top`` (at most 2**31) whose product exceeds ``product``."""
    out, made, candidate = [], 1, top - 1 if top % 2 == 0 else top
    while made <= product:
        if _is_prime(candidate):
            out.append(candidate)
            made *= candidate
        candidate -= 2
    return out


def _is_prime(n: int) -> bool:
    """Miller-Rabin; these bases decide every number below 3.2e9."""
    if n < 53:
        return n in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def characteristic_residues(matrix: list[list[int]], primes: list[int]) -> np.ndarray:
    """Coefficients (constant first) of ``det(xI - matrix)`` modulo each prime, all primes side by side."""
    p = np.array(primes, dtype=np.int64)[:, None, None]
    d = len(matrix)
    h = np.array([[[entry % q for entry in row] for row in matrix] for q in primes], dtype=np.int64).reshape(len(primes), d, d)
    every = np.arange(len(primes))
    for m in range(1, d - 1):
        pivot = m + np.argmax(h[:, m:, m - 1] != 0, axis=1)
        h[every, pivot], h[every, m] = h[every, m].copy(), h[every, pivot].copy()
        h[every, :, pivot], h[every, :, m] = h[every, :, m].copy(), h[every, :, pivot].copy()
        inverse = np.array([pow(int(x), q - 2, q) for x, q in zip(h[:, m, m - 1], primes)], dtype=np.int64)  # of 0: 0
        factor = h[:, m + 1 :, m - 1] * inverse[:, None] % p[:, 0]
        h[:, m + 1 :] = (h[:, m + 1 :] - factor[:, :, None] * h[:, m, None, :]) % p
        h[:, :, m] = (h[:, :, m] + (h[:, :, m + 1 :] * factor[:, None, :] % p).sum(axis=2)) % p[:, 0]
    made = np.zeros((len(primes), d + 1, d + 1), dtype=np.int64)  # of the leading minors
    made[:, 0, 0] = 1
    for k in range(1, d + 1):
        made[:, k, 1:] = made[:, k - 1, :-1]
        weights = np.zeros((len(primes), k), dtype=np.int64)
        below = np.ones(len(primes), dtype=np.int64)
        for i in range(k - 1, -1, -1):
            weights[:, i] = h[:, i, k - 1] * below % p[:, 0, 0]
            if i:
                below = below * h[:, i, i - 1] % p[:, 0, 0]
        made[:, k] = (made[:, k] - (weights[:, :, None] * made[:, :k] % p).sum(axis=1)) % p[:, 0]
    return made[:, d]


def join_residues(residues: list[list[int]], primes: list[int]) -> list[int]:
    """The integers nearest to zero with these residues (one row per prime)."""
    values, modulus = [0] * len(residues[0]), 1
    for row, q in zip(residues, primes):
        inverse = pow(modulus % q, q - 2, q)
        values = [v + modulus * ((r - v) * inverse % q) for v, r in zip(values, row)]
        modulus *= q
    return [v - modulus if 2 * v > modulus else v for v in values]


def coefficient_bound(matrix: list[list[int]]) -> int:
    """No coefficient of the characteristic polynomial of a positive semidefinite matrix exceeds this."""
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    return (2 + trace // d) ** d


def _scaled(polynomial: list[int], bits: int) -> list[int]:
    """The polynomial whose roots are ``2**bits`` times as large."""
    d = len(polynomial) - 1
    return [c << (bits * (d - i)) for i, c in enumerate(polynomial)]


def roots_above(polynomial: list[int], point: int) -> int:
    """Roots greater than an integer, each as often as it occurs; exact where all roots are real."""
    c = list(polynomial)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += point * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def largest_roots(polynomial: list[int], count: int, bits: int = ROOT_BITS) -> list[Fraction]:
    """The largest roots in falling order, repeated ones repeated, each to ``bits`` bits; no root is negative.

    Roots are isolated by counting; once a root is alone between two points, the sign of the polynomial tells its side.
    """
    d = len(polynomial) - 1
    positive = d - next(i for i, c in enumerate(polynomial) if c)
    top = max(1, -polynomial[d - 1]) if d else 1  # the sum of the roots
    roots: list[Fraction] = []
    for k in range(1, min(count, d) + 1):
        if k > positive:
            roots.append(Fraction(0))
            continue
        # the power of two below the root: the first exponent whose power has fewer than k roots above it
        low, high = 0, top.bit_length() + 1
        step = 64
        while roots_above(_scaled(polynomial, -low), 1) < k if low < 0 else roots_above(polynomial, 1) < k:
            high, low, step = low, low - step, 2 * step
        while high - low > 1:
            middle = (low + high) // 2
            above = roots_above(polynomial, 1 << middle) if middle >= 0 else roots_above(_scaled(polynomial, -middle), 1)
            low, high = (middle, high) if above >= k else (low, middle)
        # the root lies in (2**low, 2**high]; now as an integer with enough bits behind the point
        shift = max(0, bits - low)
        wide = _scaled(polynomial, shift)
        a, b = 1 << (low + shift), 1 << (high + shift)
        above_a, above_b = roots_above(wide, a), roots_above(wide, b)
        while b - a > 1 and above_a - above_b > 1:
            middle = (a + b) // 2
            above = roots_above(wide, middle)
            if above >= k:
                a, above_a = middle, above
            else:
                b, above_b = middle, above
        while b - a > 1 << max(0, low + shift - bits):
            if above_a - above_b > 1:
                break
            middle = (a + b) // 2
            value = 0
            for c in reversed(wide):
                value = value * middle + c
            if value == 0 or (value > 0) == (above_b % 2 == 0):
                b = middle
            else:
                a = middle
        roots.append(Fraction(a + b, 2 << shift))
    return roots


def components(matrix: list[list[int]], roots: list[Fraction], bits: int = FIXED_BITS) -> list[list[float]]:
    """Unit null vectors of ``matrix - root``; those of equal roots are orthogonal. The largest entry is positive.

    Inverse iteration on integers with ``bits`` bits behind the point; the matrix is scaled to entries below one.
    """
    d = len(matrix)
    scale = max([1, *(abs(x) for row in matrix for x in row)]).bit_length()
    base = np.array([[(x << bits) >> scale for x in row] for row in matrix], dtype=object).reshape(d, d)
    found: list[np.ndarray] = []
    for root in roots:
        shifted = base.copy()
        mu = (root.numerator << bits) // (root.denominator << scale)
        for i in range(d):
            shifted[i, i] -= mu
        lower, rows = _factor(shifted, bits)
        vector = np.array([(1 << bits) + (((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)) << (bits - 64)) for i in range(d)], dtype=object)
        for _ in range(4):
            vector = _unit(_without(_solve(lower, rows, _unit(_without(vector, found, bits), bits), bits), found, bits), bits)
        found.append(vector)
    out = []
    for vector in found:
        largest = max(vector, key=abs)
        norm = isqrt(sum(int(x) * int(x) for x in vector))
        out.append([float(Fraction(int(x) if largest > 0 else -int(x), norm)) for x in vector])
    return out


def _factor(matrix: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper factor in one matrix, with the order of the rows; an empty pivot becomes the smallest number."""
    d = len(matrix)
    rows = np.arange(d)
    for k in range(d):
        pivot = k + max(range(d - k), key=lambda i: abs(matrix[k + i, k]))
        if pivot != k:
            matrix[[k, pivot]], rows[[k, pivot]] = matrix[[pivot, k]], rows[[pivot, k]]
        if matrix[k, k] == 0:
            matrix[k, k] = 1
        if k + 1 < d:
            matrix[k + 1 :, k] = (matrix[k + 1 :, k] << bits) // matrix[k, k]
            matrix[k + 1 :, k + 1 :] -= np.outer(matrix[k + 1 :, k], matrix[k, k + 1 :]) >> bits
    return matrix, rows


def _solve(factors: np.ndarray, rows: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    x = right[rows].copy()
    for k in range(1, len(x)):
        x[k] -= int(factors[k, :k].dot(x[:k])) >> bits
    for k in range(len(x) - 1, -1, -1):
        rest = x[k] - (int(factors[k, k + 1 :].dot(x[k + 1 :])) >> bits if k + 1 < len(x) else 0)
        x[k] = (int(rest) << bits) // factors[k, k]
    return x


def _unit(vector: np.ndarray, bits: int) -> np.ndarray:
    norm = isqrt(sum(int(x) * int(x) for x in vector)) or 1
    return np.array([(int(x) << bits) // norm for x in vector], dtype=object)


def _without(vector: np.ndarray, others: list[np.ndarray], bits: int) -> np.ndarray:
    """The part of a vector that is orthogonal to the others (unit vectors)."""
    for other in others:
        along = int(vector.dot(other)) >> bits
        vector = vector - ((other * along) >> bits)
    return vector


# ---------------------------------------------------------------- Spark


def _entries(batch: pa.RecordBatch, name: str, d: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _integers(df: DataFrame, vector: str, *keep: str) -> DataFrame:
    """Rows with a finite vector, as ``x``."""
    value = F.col(f"`{vector}`")
    bad = F.exists(value, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == F.lit(float("inf"))))
    kept = df.where(value.isNotNull() & (F.size(value) > 0) & ~bad)
    too_large = F.raise_error(F.lit(f"an entry times {SCALE} is beyond {MOST}"))
    rounded = F.transform(value, lambda c: F.when(F.abs(c.cast("double")) * SCALE < MOST, F.floor(c.cast("double") * SCALE)).otherwise(too_large.cast("long")))
    return kept.select(*[F.col(f"`{k}`").alias("id") for k in keep], rounded.alias("x"))


def gram_matrix(fit: DataFrame, d: int) -> list[list[int]]:
    """Exact ``sum(y y')`` of ``y = (x, 1)``, as Python integers.

    Entries are split into two parts of 16 bits, whose products doubles sum exactly over a block; a task sends one number per part and pair
    of dimensions, and Spark adds them as decimals.
    """
    upper = np.triu_indices(d + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = np.zeros((3, len(upper[0])), dtype=np.int64)
        for batch in batches:
            x = np.column_stack((_entries(batch, "x", d), np.ones(batch.num_rows, dtype=np.int64)))
            for start in range(0, len(x), BLOCK):
                block = x[start : start + BLOCK]
                low = ((block + 2**15) & 0xFFFF) - 2**15
                high = ((block - low) >> 16).astype(np.float64)
                low = low.astype(np.float64)
                parts[2] += (low.T @ low)[upper].astype(np.int64)
                if high.any():
                    parts[0] += (high.T @ high)[upper].astype(np.int64)
                    parts[1] += (high.T @ low + low.T @ high)[upper].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.list_(pa.int64())) for part in parts], names=["hh", "hl", "ll"])

    sums = map_batches(fit.select("x"), run, "hh array<long>, hl array<long>, ll array<long>").select(F.posexplode(F.arrays_zip("hh", "hl", "ll")).alias("at", "v"))
    added = sums.groupBy("at").agg(*[F.sum(F.col(f"v.{c}").cast("decimal(38,0)")).alias(c) for c in ("hh", "hl", "ll")])
    out = [[0] * (d + 1) for _ in range(d + 1)]
    for row in added.collect():
        i, j = int(upper[0][row["at"]]), int(upper[1][row["at"]])
        out[i][j] = out[j][i] = (int(row["hh"]) << 32) + (int(row["hl"]) << 16) + int(row["ll"])
    return out


def characteristic_polynomial(spark, matrix: list[list[int]]) -> list[int]:
    """Coefficients, constant first, of a positive semidefinite integer matrix; the primes are dealt to tasks."""
    d = len(matrix)
    primes = primes_below(2**31, 2 * coefficient_bound(matrix))
    together = max(1, 2**18 // (d * d))
    given = spark.sparkContext.broadcast((matrix, primes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, primes = given.value
        for batch in batches:
            for part in batch.column(0).to_pylist():
                mine = primes[part * together : (part + 1) * together]
                residues = characteristic_residues(matrix, mine)
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([residues.tobytes()], pa.binary())], names=["part", "residues"])

    parts = -(-len(primes) // together)
    rows = sorted(map_batches(spark.range(0, parts, 1, min(parts, 200)), run, "part long, residues binary").collect())
    given.destroy()
    residues = np.concatenate([np.frombuffer(r["residues"], dtype=np.int64).reshape(-1, d + 1) for r in rows]).tolist()
    return join_residues(residues, primes)


def whiten(df: DataFrame, vector: str = "embedding", id_column: str = "vec_id", count: int = 4) -> DataFrame:
    """Per row with a finite vector and component up to ``count``: id, ``component`` (from 1), ``n``, ``deviation`` (decimal(38, 0)),
    ``whitened``, ``explained``, ``identity_error``.

    The distinct integer vectors are written under the shared folder once; the passes for the scatter and for the covariance of the whitened
    vectors read them. Rows whose vector is null, empty or holds null or non-finite entries are left out; ids may be null or repeated and
    every other row is kept. A component without variance has ``whitened`` null, ``explained`` 0 and no part in ``identity_error``. Fewer
    dimensions than ``count`` give as many components; an empty table gives no row. Vectors of several lengths, or entries of 2**23 and
    more, raise an error. Other columns, whatever their names, are left out.
    """
    has_columns(df, id_column, vector)
    spark = df.sparkSession
    kind = df.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    fit = materialize(_integers(df, vector).distinct(), "whitening-fit")
    shortest, longest = fit.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if shortest is None:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_column)
    if shortest != longest:
        raise ValueError(f"vectors of {shortest} and of {longest} entries")
    d = longest
    gram = gram_matrix(fit, d)
    n, sums = gram[d][d], gram[d][:d]
    scatter = [[n * gram[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    trace = sum(scatter[i][i] for i in range(d))
    roots = largest_roots(characteristic_polynomial(spark, scatter), min(count, d))
    directions = np.array(components(scatter, roots)).T
    mean = np.array([float(Fraction(s, n)) for s in sums])
    spread = np.array([float(r / (n * n)) for r in roots])
    explained = [float(r / trace) if trace else 0.0 for r in roots]
    scale = np.where(spread > 0, np.sqrt(np.where(spread > 0, spread, 1)), np.nan)

    def project(x: np.ndarray) -> np.ndarray:
        return (x - mean) @ directions / scale

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, k = np.zeros((len(roots) + 1, len(roots) + 1)), len(roots)
        for batch in batches:
            w = np.column_stack((project(_entries(batch, "x", d)), np.ones(batch.num_rows)))
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range((k + 1) ** 2), pa.int32()), pa.array(total.ravel())], names=["at", "v"])

    cells = dict(map_batches(fit.select("x"), squares, "at int, v double").groupBy("at").agg(F.sum("v")).collect())
    second = np.array([cells[i] for i in range((len(roots) + 1) ** 2)]).reshape(len(roots) + 1, -1) / n
    covariance = second[:-1, :-1] - np.outer(second[:-1, -1], second[:-1, -1])
    full = spread > 0
    error = float(np.abs(covariance - np.eye(len(roots)))[np.ix_(full, full)].max()) if full.any() else 0.0

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(roots)
        for batch in batches:
            x = _entries(batch, "x", d)
            if not len(x):
                continue
            w = project(x)
            rows = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(rows), n)),
                    deviations(x, n, sums).take(pa.array(rows)), pa.array(w.ravel(), mask=~np.tile(full, len(x))), pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(rows), error)),
                ],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return map_batches(_integers(df, vector, id_column), finish, schema).withColumnRenamed("id", id_column)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """``sum((n * x - S) ** 2)`` of each row, exactly, as decimals; null from 10**38 on."""
    if n * int(np.abs(x).max()) + max(map(abs, sums)) >= 2**62:  # beyond 64 bits: Python's integers
        exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    else:
        y = n * x.astype(np.int64) - np.array(sums, dtype=np.int64)
        if int(np.abs(y).max()) ** 2 * x.shape[1] < 2**62:
            return pa.array((y * y).sum(axis=1)).cast(pa.decimal128(38, 0))
        low, middle, high = y & 0x1FFFFF, (y >> 21) & 0x1FFFFF, y >> 42
        parts = [(high * high, 84), (2 * high * middle, 63), (2 * high * low + middle * middle, 42), (2 * middle * low, 21), (low * low, 0)]
        exact = [0] * len(x)
        for part, bits in parts:
            exact = [e + (int(p) << bits) for e, p in zip(exact, part.sum(axis=1))]
    return pa.array([Decimal(e) if e < 10**38 else None for e in exact], pa.decimal128(38, 0))
