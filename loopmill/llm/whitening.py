"""Whitening of embeddings by a compensated covariance and a divide-and-conquer eigen-solve.

Sums of outer products are double-double: each batch of centred vectors is cut into slices of so few bits that all
products of slices, and their sums over the batch, are exact in doubles (an error-free transformation); they are added
to a high and a low part by two-sums, and tasks' parts are merged so too. The covariance, a table of dimensions only,
is made tridiagonal and solved by halves on the driver, then its vectors are refined against high and low parts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopmill.llm.common import materialize

# Fixed values of the whole-number form.
STEPS, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Entries from this size on do not count as finite, so that all whole numbers are exact in doubles.
LARGEST = float(1 << 46)
#: Vectors of a batch, bits of a slice (twice the bits and the logarithm of the batch make 53), slices of a vector.
BATCH, SLICE_BITS, SLICES = 1024, 21, 5
#: Eigenvalues below this part of the largest have no direction of their own.
LEAST_EIGENVALUE = 1e-13
#: Eigenvalues nearer than this part of the largest are not told apart by refinement.
NEAREST = 1e-9


# -- error-free sums ---------------------------------------------------------------------------------------------------


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded sum and what rounding lost."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(hi: np.ndarray, lo: np.ndarray, b: np.ndarray, b_lo: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(hi, lo) plus (b, b_lo), as double-double."""
    s, e = two_sum(hi, b)
    t, f = two_sum(lo, np.broadcast_to(b_lo, lo.shape))
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def centred(x: np.ndarray, mean_hi: np.ndarray, mean_lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hi, lo = two_sum(x, np.broadcast_to(-mean_hi, x.shape))
    return two_sum(hi, lo - mean_lo)


def slices_of(hi: np.ndarray, lo: np.ndarray) -> list[np.ndarray]:
    """Columns of (hi, lo) as sums of SLICES matrices whose entries are SLICE_BITS bits at one place for each column."""
    top = np.abs(hi).max(axis=0, initial=0.0)
    place, out = np.ceil(np.log2(np.where(top > 0, top, 1.0))) + 1, []
    for k in range(1, SLICES + 1):
        anchor = 1.5 * np.exp2(place - k * SLICE_BITS + 52)  # adding it leaves what stands above the slice's last bit
        part = (hi + anchor) - anchor
        out.append(part)
        hi, lo = two_sum(hi - part, lo)
    return out


def add_products(hi: np.ndarray, lo: np.ndarray, y_hi: np.ndarray, y_lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hi, lo) plus the sum of outer products of the rows of (y_hi, y_lo), BATCH rows at most."""
    parts = slices_of(y_hi, y_lo)
    for s in range(SLICES):
        for t in range(s, SLICES - s):
            product = parts[s].T @ parts[t]  # exact
            hi, lo = add(hi, lo, product)
            if s != t:
                hi, lo = add(hi, lo, product.T)
    return hi, lo


# -- tables ------------------------------------------------------------------------------------------------------------


def whole_vectors(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id, x (whole numbers) of rows whose vector has only finite entries."""
    c = F.col(vector).cast("array<double>")
    known = rows.select(F.col(vec_id).alias("vec_id"), c.alias("c")).filter(F.col("c").isNotNull())
    known = known.filter(F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LARGEST)))
    return known.select("vec_id", F.transform("c", lambda v: F.floor(v * STEPS) + SHIFT).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            yield _matrix(batch.column("x").slice(at, BATCH))


def sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """The number of vectors and their exact sum, from high and low halves that stay within 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, hi, lo = 0, np.zeros(dims, dtype=np.int64), np.zeros(dims, dtype=np.int64)
        for x in _batches(batches):
            n, hi, lo = n + len(x), hi + (x >> 26).sum(axis=0), lo + (x & ((1 << 26) - 1)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(np.full(dims, n)), pa.array(hi), pa.array(lo)], names=["dim", "n", "hi", "lo"])

    found = fit.mapInArrow(run, "dim long, n long, hi long, lo long").groupBy("dim").agg(*(F.sum(c).alias(c) for c in ("n", "hi", "lo"))).orderBy("dim").collect()
    return (found[0].n, [(r.hi << 26) + r.lo for r in found]) if found else (0, [0] * dims)


def as_mean(total: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """total / n as double-double."""
    hi = [s / n for s in total]
    lo = [float((Decimal(s) - Decimal(h) * n) / n) for s, h in zip(total, hi)]
    return np.array(hi), np.array(lo)


def covariance_sums(fit: DataFrame, dims: int, of) -> tuple[np.ndarray, np.ndarray]:
    """The sum of outer products of of(x) = (hi, lo) over all rows, as (hi, lo): ``dims`` x ``dims``.

    Each task sends its parts by matrix row; these are merged as they stream by, so memory is some rows of the matrix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hi, lo = np.zeros((dims, dims)), np.zeros((dims, dims))
        for x in _batches(batches):
            hi, lo = add_products(hi, lo, *of(x))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(list(hi)), pa.array(list(lo))], names=["dim", "hi", "lo"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for dim, hi, lo in zip(batch.column("dim").to_pylist(), _matrix(batch.column("hi")), _matrix(batch.column("lo"))):
                held[dim] = add(*held[dim], hi, lo) if dim in held else (hi, lo)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([h for h, _ in held.values()]), pa.array([x for _, x in held.values()])], names=["dim", "hi", "lo"])

    kind = "dim long, hi array<double>, lo array<double>"
    found = sorted(fit.mapInArrow(run, kind).repartition("dim").mapInArrow(merge, kind).collect())
    return np.array([r.hi for r in found]), np.array([r.lo for r in found])


# -- eigenvectors of a small matrix ------------------------------------------------------------------------------------


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(d, e, q): a = q T q', where T has the diagonal d and e beside it, by Householder reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if not size or not np.any(v[1:]):
            continue
        v[0] += math.copysign(size, v[0])
        v /= np.linalg.norm(v)
        p = a[k + 1 :, k + 1 :] @ v
        w = p - (v @ p) * v
        a[k + 1 :, k + 1 :] -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1, k] -= 2 * v[0] * (v @ a[k + 1 :, k])
        a[k, k + 1] = a[k + 1, k]
        a[k + 2 :, k] = a[k, k + 2 :] = 0.0
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def _roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """(pole, shift) of the roots d[pole] + shift of 1 + rho * sum(z2 / (d - x)) = 0, one above each d, all at once.

    Shifts are measured from the nearer pole and halved in until they do not move, so they keep all their digits.
    """
    n = len(d)
    own, upper = np.arange(n), np.append(d[1:], d[-1] + rho * z2.sum())
    gap = upper - d

    def value(pole: np.ndarray, shift: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return 1 + rho * (z2 / ((d[None, :] - d[pole][:, None]) - shift[:, None])).sum(axis=1)

    right = value(own, gap / 2) < 0
    right[-1] = False
    pole = own + right
    low, high = np.where(right, -gap / 2, 0.0), np.where(right, 0.0, np.where(own == n - 1, gap, gap / 2))
    for _ in range(1100):
        # halves of exponents while the signs leave many, then of the interval
        middle = (low + high) / 2
        near, far = np.minimum(np.abs(low), np.abs(high)), np.maximum(np.abs(low), np.abs(high))
        wide = far > 4 * np.maximum(near, 1e-300)
        middle = np.where(wide, np.sign(low + high) * np.sqrt(far) * np.sqrt(np.maximum(near, 1e-300)), middle)
        still = (middle != low) & (middle != high)
        if not still.any():
            break
        below = value(pole, middle) < 0
        low, high = np.where(still & below, middle, low), np.where(still & ~below, middle, high)
    return pole, np.where(np.abs(low) > np.abs(high), low, high)


def _joined(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of diag(d) + rho * z z' (rho > 0), in no order."""
    n, order = len(d), np.argsort(d, kind="stable")
    d, z, turn = d[order].copy(), z[order].copy(), np.eye(n)[:, order]
    least = 8 * np.finfo(float).eps * max(np.abs(d).max(), rho * (z @ z))
    last = None
    for i in range(n):
        if rho * abs(z[i]) * np.linalg.norm(z) <= least:
            z[i] = 0.0
            continue
        if last is not None and d[i] - d[last] <= least:
            # two equal values: a rotation moves the weight of both to the later one
            r = math.hypot(z[last], z[i])
            c, s = z[i] / r, z[last] / r
            turn[:, [last, i]] = np.column_stack([c * turn[:, last] - s * turn[:, i], s * turn[:, last] + c * turn[:, i]])
            d[last], d[i] = c * c * d[last] + s * s * d[i], s * s * d[last] + c * c * d[i]
            z[last], z[i] = 0.0, r
        last = i
    live = np.flatnonzero(z)
    values, vectors = d.copy(), np.eye(n)
    if len(live):
        dl, zl = d[live], z[live]
        pole, shift = _roots(dl, zl * zl, rho)
        below = (dl[None, :] - dl[pole][:, None]) - shift[:, None]  # of root j (row): d - x
        # weights for which these roots are exact keep the vectors at right angles
        apart = dl[None, :] - dl[:, None]
        np.fill_diagonal(apart, 1.0)
        ratio = -below
        m = len(live)
        grid = np.ones((m, m))
        off = ~np.eye(m, dtype=bool)
        # d_i with root j of its own rank against root itself, all others against the pole of the same rank
        grid[off] = (ratio / -apart.T)[off]
        weight = np.prod(grid, axis=0) * np.diag(ratio)
        exact = np.copysign(np.sqrt(np.abs(weight)), zl)
        v = exact[None, :] / below
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        vectors[np.ix_(live, live)] = v.T
        values[live] = dl[pole] + shift
    return values, turn @ vectors


def divide_and_conquer(d: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, rising, and vectors (columns) of the tridiagonal matrix with d, and e beside it."""
    n = len(d)
    if n == 1:
        return d.copy(), np.ones((1, 1))
    m, rho = n // 2, abs(e[n // 2 - 1])
    one, two = d[:m].copy(), d[m:].copy()
    one[-1] -= rho
    two[0] -= rho
    (d1, q1), (d2, q2) = divide_and_conquer(one, e[: m - 1]), divide_and_conquer(two, e[m:])
    q = np.zeros((n, n))
    q[:m, :m], q[m:, m:] = q1, q2
    values, vectors = np.concatenate([d1, d2]), q
    if rho:
        values, u = _joined(values, np.concatenate([q1[-1], math.copysign(1.0, e[m - 1]) * q2[0]]), rho)
        vectors = q @ u
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


def refined(hi: np.ndarray, lo: np.ndarray, vectors: np.ndarray, steps: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Steps towards the eigenvectors of (hi, lo), in long doubles; values are Rayleigh quotients.

    Vectors whose values are too near to be told apart are only set at right angles to each other.
    """
    a, x = hi.astype(np.longdouble) + lo.astype(np.longdouble), vectors.astype(np.longdouble)
    for _ in range(steps):
        r, s = np.eye(len(x)) - x.T @ x, x.T @ a @ x
        value = np.diag(s) / (1 - np.diag(r))
        gap = value[None, :] - value[:, None]
        apart = np.abs(gap) > NEAREST * np.abs(value).max()
        step = np.where(apart, (s + value[None, :] * r) / np.where(apart, gap, 1), r / 2)
        np.fill_diagonal(step, np.diag(r) / 2)
        x = x + x @ step
    x = x + x @ ((np.eye(len(x)) - x.T @ x) / 2)
    return value.astype(float), x.astype(float)


def eigen(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit vectors (columns) of the symmetric (hi, lo); the largest entry is positive."""
    size = np.abs(hi).max(initial=0.0)
    if not size:
        return np.zeros(len(hi)), np.eye(len(hi))
    hi, lo = hi / 2.0 ** math.ceil(math.log2(size)), lo / 2.0 ** math.ceil(math.log2(size))
    d, e, q = tridiagonal((hi + hi.T) / 2)
    _, vectors = divide_and_conquer(d, e)
    value, vectors = refined(hi, lo, q @ vectors)
    vectors = vectors / np.linalg.norm(vectors, axis=0)
    order = np.argsort(-value, kind="stable")
    value, vectors = value[order], vectors[:, order]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(hi))])
    return np.maximum(value, 0.0) * 2.0 ** math.ceil(math.log2(size)), vectors * np.where(sign == 0, 1, sign)


# -- the operator ------------------------------------------------------------------------------------------------------


@dataclass
class Whitening:
    """What a fit list gives: n vectors with exact sums, and for each kept component its vector, value and share."""

    n: int
    total: list[int]
    vectors: np.ndarray  #: dimension x component
    values: np.ndarray
    trace: float
    identity_error: float | None = None

    def centre(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return centred(x.astype(np.float64), *as_mean(self.total, self.n))

    def usable(self) -> np.ndarray:
        return self.values > LEAST_EIGENVALUE * self.values[0]

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; NaN where a component has no variance."""
        hi, lo = self.centre(x)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.usable(), (hi @ self.vectors + lo @ self.vectors) / np.sqrt(self.values), np.nan)

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - S) ** 2, exact: in 64 bits where that holds them, else in whole numbers."""
        base = np.array([s // self.n for s in self.total])
        rest = [s - self.n * int(b) for s, b in zip(self.total, base)]
        small = x - base
        if self.n * (int(np.abs(small).max(initial=0)) + 1) < math.isqrt((1 << 63) // max(x.shape[1], 1)):
            return ((self.n * small - np.array(rest)) ** 2).sum(axis=1).tolist()
        return [sum((self.n * v - r) ** 2 for v, r in zip(row, rest)) for row in small.tolist()]


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of the distinct vectors x of a table (x array<long>, of one length); None if there are none."""
    listed = materialize(vectors.select("x").distinct())
    first = listed.first()
    if first is None or not len(first.x):
        return None
    dims = len(first.x)
    n, total = sums(listed, dims)
    found = Whitening(n, total, np.zeros((dims, 0)), np.zeros(0), 0.0)
    hi, lo = covariance_sums(listed, dims, found.centre)
    value, vector = eigen(hi / n, lo / n)
    found.vectors, found.values = vector[:, :components], value[:components]
    found.trace = float(np.trace(hi) / n)
    use = found.usable() if found.trace else np.zeros(len(found.values), dtype=bool)
    if use.any():
        kept = np.flatnonzero(use)
        # the whitened rows' own mean, then their products about it
        w_sums = listed.mapInArrow(_whitened_sums(found, kept), "dim int, value double").groupBy("dim").agg(F.sum("value").alias("value")).collect()
        mean = np.zeros(len(kept))
        for r in w_sums:
            mean[r.dim] = r.value / n
        hi, lo = covariance_sums(listed, len(kept), lambda x: (y := found.project(x)[:, kept] - mean, np.zeros_like(y)))
        found.identity_error = float(np.abs((hi + lo) / n - np.eye(len(kept))).max())
    return found


def _whitened_sums(model: Whitening, kept: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(kept))
        for x in _batches(batches):
            total += model.project(x)[:, kept].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(kept), dtype=np.int32)), pa.array(total)], names=["dim", "value"])

    return run


_WHITENED = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id and, for each component up to ``components``, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, has a null or no finite entry (LARGEST or more counts as none), is empty or shorter
    than the table's longest are left out. Entries become x = floor(STEPS * entry) + SHIFT; mean and covariance
    are those of the distinct x. Rows of equal vectors have equal values, repeated rows a row each. Components stand
    by falling eigenvalue; those without variance (LEAST_EIGENVALUE) have a null in ``whitened``; ``explained`` is
    null if there is no variance at all. ``deviation`` is exact up to 38 digits. No row is left: no result.
    The matrix has the square of the dimension as its size, on each task and the driver: 1,000 dimensions take 16 MB.
    """
    known = whole_vectors(rows, vec_id, vector)
    dims = known.agg(F.max(F.size("x")).alias("d")).first().d
    kind = known.schema["vec_id"].dataType.simpleString()
    known = known.filter(F.size("x") == F.lit(dims or -1))
    model = fit(known, components)
    if model is None:
        return known.sparkSession.createDataFrame([], f"vec_id {kind}, {_WHITENED}")
    share = model.values / model.trace if model.trace else np.full(len(model.values), np.nan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                x = _matrix(part.column("x"))
                m, white = len(x), model.project(x).ravel()
                no = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(pa.array(no)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, model.n)),
                        pa.array([Decimal(d) for d in model.deviation(x)], type=pa.decimal128(38, 0)).take(pa.array(no)),
                        pa.array(white, mask=np.isnan(white)),
                        pa.array(np.tile(share, m), mask=np.isnan(np.tile(share, m))),
                        pa.array([model.identity_error] * (m * k), type=pa.float64()),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return known.mapInArrow(run, f"vec_id {kind}, {_WHITENED}")


def deviation_long() -> Column:
    """``deviation`` in 64 bits; null beyond them."""
    return F.col("deviation").try_cast("long")
