"""Whitening against a plain eigenvalue solver, counts and sums against whole numbers of any size."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roomtide.llm import whitening
from roomtide.llm.whitening import Spectrum, positive_pivots


@settings(deadline=None, max_examples=40)
@given(st.integers(0, 10**6), st.integers(1, 14), st.sampled_from([0.0, 0.5, -1.0, 2.0]))
def test_inertia(seed, size, shift):
    rng = np.random.default_rng(seed)
    m = rng.integers(-2, 3, (size, size)).astype(float)
    m = m + m.T
    values = np.linalg.eigvalsh(m - shift * np.eye(size))
    if np.abs(values).min() > 1e-9:
        assert positive_pivots(m - shift * np.eye(size)) == (values > 0).sum()


@pytest.mark.parametrize("size, rank", [(1, 1), (2, 2), (5, 3), (40, 40), (64, 64), (64, 10)])
def test_leading_eigenvalues(size, rank):
    rng = np.random.default_rng(size + rank)
    a = rng.standard_normal((size, rank)) * rng.uniform(0.01, 3, rank)
    m = a @ a.T
    values, vectors = Spectrum(m).leading(16)
    want = np.linalg.eigvalsh(m)[::-1]
    assert len(values) == min(16, rank)
    assert np.allclose(values, want[: len(values)], rtol=0, atol=1e-13 * want[0])
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
    assert np.abs(m @ vectors - vectors * values).max() < 1e-13 * want[0]


@pytest.mark.parametrize("diagonal", [[5.0] * 20 + [3.0] * 10 + [1e-3] * 10, [2.0] * 6, [1.0, 1.0 + 1e-12, 1.0 + 2e-12, 0.5], [0.0] * 4])
def test_equal_and_close_eigenvalues(diagonal):
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((len(diagonal), len(diagonal))))[0]
    m = q * diagonal @ q.T
    values, vectors = Spectrum(m).leading(16)
    want = sorted(diagonal, reverse=True)[: min(16, sum(d > 0 for d in diagonal))]
    assert np.allclose(values, want, rtol=0, atol=1e-12)
    assert np.allclose(vectors.T @ vectors, np.eye(len(want)), atol=1e-10)


def test_a_wrong_number_is_not_certified():
    with pytest.raises(ArithmeticError):
        Spectrum(np.diag([4.0, 3.0, 2.0])).certify(np.array([4.0, 2.0]))


SCHEMA = "vec_id long, embedding array<float>, label int, n long, component string, x string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 5, "x", "y") for i, v in rows], SCHEMA).repartition(3)


def check(spark, rows):
    """Against the contract, the vectors' signs apart."""
    length = max(len(v) for _, v in rows if v)
    ok = [(i, v) for i, v in rows if v and len(v) == length and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(64 * np.array([v for _, v in ok], np.float32).astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, centred = len(fit), fit - fit.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    share = values[::-1] / values.sum()
    got = sorted(map(tuple, whitening.whitened(table(spark, rows)).collect()))
    k = max(r[1] for r in got)
    want = (x - fit.mean(axis=0)) @ vectors[:, ::-1][:, :k] / np.sqrt(values[::-1][:k])
    order = sorted(range(len(ok)), key=lambda i: ok[i][0])
    assert [(r[0], r[1]) for r in got] == [(ok[i][0], c + 1) for i in order for c in range(k)]
    assert {r[2] for r in got} == {n}
    sums = [int(s) for s in fit.sum(axis=0)]
    assert [r[3] for r in got] == [sum((n * int(a) - s) ** 2 for a, s in zip(x[i], sums, strict=True)) for i in order for _ in range(k)]
    found = np.array([r[4] for r in got]).reshape(-1, k)
    want = want[order]
    assert np.allclose(found * np.sign((found * want).sum(axis=0)), want, atol=1e-8)
    assert np.allclose([r[5] for r in got], np.tile(share[:k], len(ok)), rtol=1e-9)
    assert len({r[6] for r in got}) == 1 and got[0][6] < 1e-9
    return k


def test_whitened(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 20)) @ rng.standard_normal((20, 20))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, x[3].tolist()) for i in range(200)]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 19 + [None]), (2003, [float("nan")] * 20), (2004, [float("inf")] * 20), (2005, [1.0, 2.0])]
    assert check(spark, rows) == 16


def test_fewer_dimensions_than_components(spark):
    rng = np.random.default_rng(6)
    assert check(spark, [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((50, 3)) * 40)]) == 3
    flat = np.repeat(rng.standard_normal((50, 1)) * 100, 4, axis=1)
    assert check(spark, [(i, v.tolist()) for i, v in enumerate(flat)]) == 1


def test_tables_without_variance_or_rows(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        found = whitening.whitened(table(spark, rows))
        assert found.count() == 0
        assert [f.name for f in found.schema] == [f.split()[0] for f in whitening.WHITENED.split(", ")]


def test_null_and_repeated_ids(spark):
    rows = [(None, [1.0, 2.0]), (1, [3.0, -4.0]), (1, [3.0, 9.0]), (1, [3.0, 9.0])]
    found = whitening.whitened(table(spark, rows))
    assert found.filter("vec_id IS NULL").count() == 2 and found.filter("vec_id = 1").count() == 6
    assert {r["n"] for r in found.collect()} == {3}


def test_large_entries(spark):
    """Sums and deviations stay exact beyond the range of a double, and are null beyond 64 bits."""
    rows = [(i, [float(i), 2.0**20 * (i % 3), -3.0]) for i in range(40)]
    check(spark, rows)
    huge = whitening.whitened(table(spark, [(i, [float(i) * 2.0**40, 1.0]) for i in range(5)]))
    assert {r["deviation"] for r in huge.collect()} >= {None}
    assert whitening.Sums(3, [7, 2**64]).deviations(np.array([[2, 2**62]])) == [(6 - 7) ** 2 + (3 * 2**62 - 2**64) ** 2 if (3 * 2**62 - 2**64) ** 2 < 2**63 else None]
