"""Whitening against numpy's eigenvectors and plain whole numbers."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from sitescan.llm import whitening as w

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    """x by id of the rows that stay, then n, sums and the covariance's eigenvalues and vectors, falling."""
    x = {i: tuple(math.floor(256 * float(np.float32(c))) for c in v) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    fit = sorted(set(x.values()))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    a = np.array(fit, float) - np.array(sums) / n
    e, v = np.linalg.eigh(a.T @ a / n)
    return x, n, sums, e[::-1], v[:, ::-1].T


def held(got, rows, components=4, near=1e-9):
    x, n, sums, e, v = plain(rows)
    k = min(components, len(sums))
    assert len(got) == len(x) * k
    turn = {}
    for r in got:
        i = r.component - 1
        assert r.n == n and r.deviation == sum((n * c - s) ** 2 for c, s in zip(x[r.vec_id], sums, strict=True))
        want = float((np.array(x[r.vec_id]) - np.array(sums) / n) @ v[i] / math.sqrt(e[i]))
        if abs(want) > 1e-3:
            sign = turn.setdefault(i, math.copysign(1, want) * math.copysign(1, r.whitened))
            assert abs(want - sign * r.whitened) < near
        assert abs(r.explained / (e[i] / e.sum()) - 1) < 1e-9 and 0 <= r.identity_error < 1e-9


@pytest.fixture(scope="module")
def vectors():
    rnd = np.random.default_rng(3)
    spread = rnd.normal(size=(9, 9)) * np.linspace(1, 0.1, 9)
    rows = [(i, [float(c) for c in np.float32(v @ spread)], 1) for i, v in enumerate(rnd.normal(size=(300, 9)))]
    odd = [(900, None, 1), (901, [1.0, None] + [0.0] * 7, 1), (902, [math.nan] * 9, 1), (903, [math.inf] + [0.0] * 8, 1), (904, [-0.0] * 9, 1)]
    return rows + odd + [(1000 + i, rows[0][1], 2) for i in range(200)]


def test_against_numpy(spark, vectors):
    held(w.components_of(spark.createDataFrame(vectors, SCHEMA)).collect(), vectors)


def test_on_given_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    held(w.components_of(df).collect(), rows)


def test_polynomial_is_exact(spark):
    rnd = random.Random(2)
    for d in (1, 2, 5, 8):
        a = [[rnd.randint(-50, 50) if rnd.random() < 0.7 else 0 for _ in range(d)] for _ in range(d + 2)]
        g = [[sum(r[i] * r[j] for r in a) for j in range(d)] for i in range(d)]
        poly = w.characteristic_polynomial(spark, g)
        for t in range(d + 1):  # a polynomial of degree d is told by d + 1 values
            m = [[Fraction((t if i == j else 0) - g[i][j]) for j in range(d)] for i in range(d)]
            det = Fraction(1)
            for k in range(d):
                p = next((i for i in range(k, d) if m[i][k]), None)
                if p is None:
                    det = Fraction(0)
                    break
                if p != k:
                    m[k], m[p], det = m[p], m[k], -det
                det *= m[k][k]
                for i in range(k + 1, d):
                    f = m[i][k] / m[k][k]
                    m[i] = [x - f * y for x, y in zip(m[i], m[k], strict=True)]
            assert sum(c * t**k for k, c in enumerate(poly)) == det


def test_modular_reduction_with_zero_pivots():
    g = [[0, 0, 1, 0], [0, 2, 0, 0], [1, 0, 0, 5], [0, 0, 5, 0]]
    p = 2**31 - 1
    want = [round(c) % p for c in reversed(np.poly(np.array(g, float)))]
    assert w.polynomial_modulo(g, p) == want


def test_roots_are_counted_and_isolated():
    poly = [1]
    for r in (2, 2, 7, 100, 100, 100, 0):
        poly = [(poly[k - 1] if k else 0) - (r * poly[k] if k < len(poly) else 0) for k in range(len(poly) + 1)]
    assert [w.roots_beyond(poly, t, 0) for t in (-1, 0, 1, 2, 6, 7, 99, 100)] == [7, 6, 6, 4, 4, 3, 3, 0]
    found = w.largest_roots(poly, 5, 101, 40)
    assert [(round(r / 2**40, 6), n) for r, n in found] == [(100.0, 3), (7.0, 1), (2.0, 2)]


def test_equal_eigenvalues(spark):
    rows = [(i, [float(s) if k == j else 0.0 for k in range(4)], 0) for i, (j, s) in enumerate((j, s) for j in range(4) for s in (-1, 1))]
    got = w.components_of(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 32 and all(abs(r.explained - 0.25) < 1e-12 and r.identity_error < 1e-12 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r.whitened)
    for v in by.values():  # the four coordinates keep the length whatever the axes
        assert abs(sum(c * c for c in v) - 4) < 1e-9


def test_large_numbers_stay_exact(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.uniform(-1e12, 1e12) for _ in range(3)], 0) for i in range(60)]
    got = w.components_of(spark.createDataFrame(rows, SCHEMA.replace("float", "double"))).collect()
    assert len(got) == 180 and all(r.deviation is None and r.identity_error < 1e-9 for r in got)
    few = [(0, [3e13], 0), (1, [3e13 + 1], 0)]
    got = w.components_of(spark.createDataFrame(few, SCHEMA.replace("float", "double"))).collect()
    assert sorted((r.vec_id, r.n, r.deviation, abs(round(r.whitened, 9))) for r in got) == [(0, 2, 65536, 1.0), (1, 2, 65536, 1.0)]
    assert got[0].whitened * got[1].whitened < 0


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [], 0)], [(1, [0.5, 0.25], 0)] * 3])
def test_nothing_to_whiten(spark, rows):
    assert w.components_of(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_short_vectors_null_ids_and_clashing_names(spark):
    rows = [(None, [1.0, 2.0], 0, 5), (1, [3.0], 0, 6), (2, [3.0, 0.0], 0, 7), (3, [], 0, 8)]
    got = w.components_of(spark.createDataFrame(rows, SCHEMA + ", n int")).collect()
    assert len(got) == 8 and {r.n for r in got} == {3}
    twins = sorted((r.component, round(r.whitened, 9)) for r in got if r.vec_id in (1, 2))
    assert twins[0] == twins[1] and twins[2] == twins[3]
