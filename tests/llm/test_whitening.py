"""Whitening against exact rational arithmetic and numpy's eigenvectors."""

from __future__ import annotations

from collections import defaultdict
from fractions import Fraction
from math import floor, inf, nan

import numpy as np
import pyarrow.parquet as pq
import pytest
from ledgerlake.llm.queries import op12_whitening
from ledgerlake.llm.whitening import (
    characteristic_polynomial, characteristic_residues, coefficient_bound, components, deviations, gram_matrix, join_residues, largest_roots, primes_below, roots_above,
    whiten,
)


def _polynomial(matrix):
    """Characteristic polynomial by Faddeev and LeVerrier, in rationals."""
    d = len(matrix)
    work, out = [[Fraction(0)] * d for _ in range(d)], [Fraction(1)]
    for k in range(1, d + 1):
        for i in range(d):
            work[i][i] += out[-1]
        work = [[sum(matrix[i][m] * work[m][j] for m in range(d)) for j in range(d)] for i in range(d)]
        out.append(-sum(work[i][i] for i in range(d)) / k)
    return [int(c) for c in reversed(out)]


def _own(matrix):
    primes = primes_below(2**31, 2 * coefficient_bound(matrix))
    return join_residues(characteristic_residues(matrix, primes).tolist(), primes)


def _gram(rows):
    x = [[int(v) for v in r] for r in rows]
    return [[sum(r[i] * r[j] for r in x) for j in range(len(x[0]))] for i in range(len(x[0]))]


@pytest.mark.parametrize("d", [1, 2, 3, 5, 9])
def test_polynomial_is_exact(d):
    rng = np.random.default_rng(d)
    for matrix in (_gram(rng.integers(-900, 900, (20, d))), _gram(rng.integers(-9, 9, (2, d))), [[0] * d for _ in range(d)], [[3 * (i == j) for j in range(d)] for i in range(d)]):
        assert _own(matrix) == _polynomial(matrix)


def test_primes():
    assert primes_below(50, 47 * 43) == [47, 43, 41]
    few = primes_below(2**31, 10**30)
    assert few[0] == 2**31 - 1 and all(all(p % q for q in range(3, 1000, 2)) for p in few)


def test_roots_and_vectors():
    rng = np.random.default_rng(3)
    matrix = _gram(rng.integers(-200, 200, (40, 12)))
    polynomial = _own(matrix)
    values, vectors = np.linalg.eigh(np.array(matrix, dtype=float))
    roots = largest_roots(polynomial, 5)
    assert [float(r) for r in roots] == pytest.approx(values[::-1][:5].tolist(), rel=1e-12)
    for k, vector in enumerate(components(matrix, roots)):
        assert abs(np.dot(vector, vectors[:, -1 - k])) == pytest.approx(1, abs=1e-12)
    assert roots_above(polynomial, -1) == 12 and roots_above(polynomial, sum(matrix[i][i] for i in range(12))) == 0


def test_repeated_tiny_and_zero_roots():
    assert [float(r) for r in largest_roots([0, 0, 1], 2)] == [0, 0]
    twice = [[5, 0, 0, 0], [0, 5, 0, 0], [0, 0, 2, 0], [0, 0, 0, 0]]
    roots = largest_roots(_own(twice), 4)
    assert [float(r) for r in roots] == [5, 5, 2, 0]
    basis = np.array(components(twice, roots))
    assert basis @ basis.T == pytest.approx(np.eye(4), abs=1e-15)
    assert np.abs(basis[:2, 2:]).max() < 1e-15
    # eigenvalues near 1e9 and 1e-9: the product of the roots is 1
    near = [[10**9 + 1, 10**9], [10**9, 10**9 - 1 + 0]]
    near[1][1] = (10**18 + 1) // (10**9 + 1) + 1
    exact = largest_roots(_own(near), 2)
    determinant = near[0][0] * near[1][1] - near[0][1] ** 2
    assert float(exact[0] * exact[1] / determinant) == pytest.approx(1, rel=1e-14)
    # neighbours that a double can't tell apart
    close = [[2**60, 1], [1, 2**60]]
    pair = largest_roots(_own(close), 2)
    assert float(pair[0] - pair[1]) == pytest.approx(2, rel=1e-12)
    assert np.abs(np.array(components(close, pair))) == pytest.approx(np.full((2, 2), 0.5**0.5), abs=1e-15)


def _check(got, vectors, count=4):
    """Result rows against a direct computation over (id, vector) pairs."""
    kept = [(i, [floor(256 * float(np.float64(c))) for c in v]) for i, v in vectors if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[i] for x in fit) for i in range(d)]
    centred = np.array([[float(Fraction(n * x[i] - sums[i], n)) for i in range(d)] for x in fit])
    covariance = centred.T @ centred / n
    values, directions = np.linalg.eigh(covariance)
    values, directions = values[::-1], directions[:, ::-1]
    by_component = defaultdict(list)
    for row in got:
        by_component[row["component"]].append(row)
    assert set(by_component) == set(range(1, min(count, d) + 1))
    errors = {row["identity_error"] for row in got}
    assert len(errors) == 1 and errors.pop() <= 1e-9
    key = lambda i: (i is not None, i if i is not None else 0)
    for component, rows in by_component.items():
        want = sorted(((i, sum((n * v - s) ** 2 for v, s in zip(x, sums)), x) for i, x in kept), key=lambda r: (key(r[0]), r[2]))
        assert sorted((key(r["vec_id"]), r["deviation"]) for r in rows) == sorted((key(i), t) for i, t, _ in want)
        assert {r["n"] for r in rows} == {n}
        assert {r["explained"] for r in rows}.pop() == pytest.approx(values[component - 1] / values.sum(), rel=1e-9)
        if values[component - 1] > 1e-9:
            expected = {}
            for i, _, x in want:
                centre = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)])
                expected.setdefault(i, []).append(float(centre @ directions[:, component - 1] / values[component - 1] ** 0.5))
            made = defaultdict(list)
            for r in rows:
                made[r["vec_id"]].append(r["whitened"])
            sign = np.sign(sum(a * b for i in expected for a, b in zip(sorted(expected[i], key=abs), sorted(made[i], key=abs))))
            for i, numbers in expected.items():
                assert sorted(sign * v for v in made[i]) == pytest.approx(sorted(numbers), abs=1e-9)
        else:
            assert {r["whitened"] for r in rows} == {None}


def test_whole_table(spark):
    got = op12_whitening(spark, "/root/testdata/sf0.01").collect()
    table = pq.read_table("/root/testdata/sf0.01/embeddings.parquet").to_pylist()
    _check(got, [(r["vec_id"], r["embedding"]) for r in table])


def test_nulls_repeats_and_clashing_columns(rows):
    rng = np.random.default_rng(7)
    data = [(i, rng.normal(0, 1, 6).tolist()) for i in range(60)]
    data += [(None, data[0][1]), (1, data[1][1]), (100, None), (101, []), *[(110 + k, [bad, 1.0, 2.0, 3.0, 4.0, 5.0]) for k, bad in enumerate((None, nan, inf, -inf))]]
    data += [(200 + i, data[2][1]) for i in range(40)]
    frame = rows("vec_id BIGINT, embedding ARRAY<DOUBLE>, x INT, component INT, n STRING", *[(*r, 1, 2, "3") for r in data]).repartition(6)
    made = whiten(frame)
    assert made.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    _check(made.collect(), data)


def test_few_dimensions_and_no_variance(rows):
    ddl = "vec_id BIGINT, embedding ARRAY<FLOAT>"
    _check(whiten(rows(ddl, (1, [0.5, 1.0]), (2, [0.25, -1.0]), (3, [3.0, 2.0]))).collect(), [(1, [0.5, 1.0]), (2, [0.25, -1.0]), (3, [3.0, 2.0])])
    alone = whiten(rows(ddl, (1, [0.5, 1.0]), (2, [0.5, 1.0]))).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in alone] == [(1, 0, None, 0.0, 0.0)] * 4
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(5)]
    _check(whiten(rows(ddl, *line)).collect(), line)
    empty = whiten(rows(ddl, (1, [0.5])).limit(0))
    assert empty.count() == 0 and empty.columns[0] == "vec_id"
    assert whiten(rows(ddl, (1, None))).count() == 0
    with pytest.raises(ValueError, match="vectors of 1 and of 2"):
        whiten(rows(ddl, (1, [0.5]), (2, [0.5, 1.0])))


def test_large_entries(spark, rows):
    data = [[2**30 - 1, -(2**30)], [12345, 2**29 + 7], [-(2**31) + 1, 40_000]]
    frame = rows("x ARRAY<BIGINT>", *[(x,) for x in data])
    extended = [[*x, 1] for x in data]
    assert gram_matrix(frame, 2) == [[sum(r[i] * r[j] for r in extended) for j in range(3)] for i in range(3)]
    for n, sums in ((3, [5, 7]), (2**20, [2**40, -(2**41)]), (2**31, [2**50, 3])):
        assert [int(v) for v in deviations(np.array(data), n, sums).to_pylist()] == [sum((n * v - s) ** 2 for v, s in zip(x, sums)) for x in data]
    assert deviations(np.array(data), 2**34, [0, 0]).to_pylist()[0] is None
    matrix = _gram([[1, 2], [3, 5], [3, 9]])
    assert characteristic_polynomial(spark, matrix) == _polynomial(matrix)
