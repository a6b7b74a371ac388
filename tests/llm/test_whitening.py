"""Operator 12: exact sums and products, the eigen-solve, and whitening against plain numpy."""

from fractions import Fraction

import numpy as np
import pytest

from loopmill.llm import registry, whitening


def matrices():
    draw = np.random.default_rng(1)
    square = lambda n, m: (lambda x: x @ x.T)(draw.normal(size=(n, m)))
    turned = np.linalg.qr(draw.normal(size=(30, 30)))[0]
    wilkinson = np.diag(np.abs(np.arange(-10, 11.0)) + 3) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    return [square(64, 80), square(40, 5), 3 * np.eye(10), np.diag(np.arange(8.0)), turned @ np.diag(2.0 ** np.arange(0, -30, -1)) @ turned.T, np.array([[2.0]]), np.array([[2.0, -1.0], [-1.0, 2.0]]), np.zeros((5, 5)), wilkinson]


@pytest.mark.parametrize("k", range(9))
def test_eigen_solve(k):
    a = matrices()[k]
    size = max(np.abs(a).max(), 1e-300)
    d, e, q = whitening.tridiagonal(a)
    assert np.abs(q @ (np.diag(d) + np.diag(e, 1) + np.diag(e, -1)) @ q.T - a).max() <= 1e-14 * size * len(a)
    value, vector = whitening.divide_and_conquer(d, e)
    assert np.abs(value - np.linalg.eigvalsh(a)).max() <= 1e-14 * size * len(a)
    assert np.abs(vector.T @ vector - np.eye(len(a))).max() <= 1e-14 * len(a)
    value, vector = whitening.eigen(a, np.zeros_like(a))
    assert (np.diff(value) <= 0).all() and np.abs(a @ vector - vector * value).max() <= 1e-13 * size
    assert np.abs(vector.T @ vector - np.eye(len(a))).max() <= 1e-11


def test_products_are_double_double():
    draw = np.random.default_rng(2)
    x = draw.integers(-40, 40, size=(2500, 5)).astype(float) * [1, 1000, 1, 1e6, 0] + 1e6
    total = [int(v) for v in x.sum(axis=0)]
    mean = whitening.as_mean(total, len(x))
    hi, lo = np.zeros((5, 5)), np.zeros((5, 5))
    for at in range(0, len(x), whitening.BATCH):
        hi, lo = whitening.add_products(hi, lo, *whitening.centred(x[at : at + whitening.BATCH], *mean))
    for i in range(5):
        for j in range(5):
            exact = sum((Fraction(int(r[i])) - Fraction(total[i], len(x))) * (Fraction(int(r[j])) - Fraction(total[j], len(x))) for r in x)
            got = Fraction(hi[i, j]) + Fraction(lo[i, j])
            scale = abs(exact) + Fraction(float(np.abs(x[:, i] - x[:, i].mean()).max() * np.abs(x[:, j] - x[:, j].mean()).max()))
            assert abs(got - exact) <= scale * Fraction(1, 2**90)


def plain(rows):
    """(ids, exact numbers, n, sums, whitened, share) of rows of finite vectors, by numpy on long doubles."""
    x = {i: [int(np.floor(64 * float(c))) + 1_000_000 for c in v] for i, v in rows}
    fit = sorted({tuple(v) for v in x.values()})
    n, total = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[Fraction(n * c - s, n) for c, s in zip(v, total)] for v in fit]).astype(np.longdouble)
    value, vector = np.linalg.eigh((y.T @ y / n).astype(float))
    return x, n, total, value[::-1], vector[:, ::-1]


def test_query_on_a_table(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    x, n, total, value, vector = plain(rows)
    got = {}
    for r in registry.op12_whitening(spark, sf).collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    assert got.keys() == x.keys() and all(sorted(v) == list(range(1, 17)) for v in got.values())
    signs = None
    for i, v in x.items():
        deviation = sum((n * c - s) ** 2 for c, s in zip(v, total))
        centred = np.array([(n * c - s) / n for c, s in zip(v, total)])
        white = centred @ vector[:, :16] / np.sqrt(value[:16])
        mine = np.array([got[i][k].whitened for k in range(1, 17)])
        signs = np.sign(white * mine) if signs is None else signs
        assert {got[i][k].deviation for k in range(1, 17)} == {deviation} and got[i][1].n == n
        assert mine == pytest.approx(signs * white, abs=1e-9)
    share = [got[next(iter(x))][k].explained for k in range(1, 17)]
    assert share == pytest.approx(value[:16] / value.sum(), rel=1e-9) and got[next(iter(x))][1].identity_error <= 1e-10


KIND = "vec_id long, embedding array<float>, n string"


def test_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], "a"), (1, [1.0, 2.0], "b"), (2, [3.0, -2.0], "c"), (None, [0.5, 0.25], None), (4, None, ""), (5, [None, 1.0], ""), (6, [nan, 1.0], ""), (7, [inf, 1.0], ""), (8, [], ""), (9, [1.0], ""), (10, [1e30, 1.0], "")]
    got = whitening.whiten(spark.createDataFrame(rows, KIND)).collect()
    assert sorted((str(r.vec_id), r.component) for r in got) == sorted((i, k) for i in ("1", "1", "2", "None") for k in (1, 2))
    assert {r.n for r in got} == {3} and got[0].identity_error <= 1e-12
    assert whitening.whiten(spark.createDataFrame([], KIND)).count() == 0 and whitening.whiten(spark.createDataFrame(rows[4:9], KIND)).count() == 0
    same = whitening.whiten(spark.createDataFrame(rows[:2], KIND)).collect()
    assert [(r.whitened, r.explained, r.identity_error, int(r.deviation)) for r in same] == [(None, None, None, 0)] * 4
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0], "") for i in range(6)], KIND)).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in line) and line[0].explained == pytest.approx(1.0)


def test_deviation_beyond_64_bits():
    model = whitening.Whitening(10**9, [10**15 + 7, -(10**16)], np.eye(2), np.ones(2), 2.0)
    x = np.array([[1_000_000, 3], [10**12, -(10**12)]])
    assert model.deviation(x) == [sum((10**9 * int(v) - s) ** 2 for v, s in zip(row, model.total)) for row in x]
    small = whitening.Whitening(10, [10**7 + 3, 10**7 - 5], np.eye(2), np.ones(2), 2.0)
    near = np.array([[1_000_000, 999_999], [1_000_040, 999_960]])
    assert small.deviation(near) == [sum((10 * int(v) - s) ** 2 for v, s in zip(row, small.total)) for row in near]
