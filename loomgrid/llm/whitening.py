"""Whitening of embeddings along the leading eigenvectors of their covariance, found by spectrum slicing.

Entries become integers, so counts, sums and products of the whole table are exact, whatever the order of tasks. The
covariance is taken about the floored mean and corrected by the exact rest. It has a row and a column per
dimension, so it alone reaches the driver, as one row per pair of dimensions.

An LDL^T factorisation of the covariance minus a shift, with symmetric pivoting in blocks of 1 and 2, has as many
positive pivots as there are eigenvalues above the shift. Such counts, shared by all components, halve intervals until each leading eigenvalue is
alone in one; a Rayleigh quotient iteration from there converges cubically; counts just above and just below the result certify its number. Eigenvalues
that no shift parts in double precision share an interval, and their vectors are made orthogonal.

Cases: rows whose vector is null or holds null, NaN or infinite entries are dropped; a shorter vector has zeros behind it (of entries, not of their
integers); integers are held to +-2**40; a deviation beyond a long is null; repeated rows count as often as they stand; rows without an id are rows like others; directions
with less than 1e-10 of the greatest eigenvalue can't be whitened and have no component, so a table of equal rows, and an empty one, gives no
rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .topk import matrix_of, whole_vectors

#: Integers of an entry c are floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Components at most; share of the greatest eigenvalue below which a direction is none.
COMPONENTS, NO_DIRECTION = 32, 1e-10
#: Bound of an entry's integer.
MOST = 1 << 40
_BK = (1 + math.sqrt(17)) / 8


def count_above(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix exceed ``shift``: the positive pivots of LDL^T."""
    m = a - shift * np.eye(len(a))
    above = 0
    while len(m):
        if len(m) == 1:
            return above + int(m[0, 0] > 0)
        below = np.abs(m[1:, 0])
        p = int(below.argmax()) + 1
        lam, d = below[p - 1], abs(m[0, 0])
        if lam == 0:
            above += int(m[0, 0] > 0)
            m = m[1:, 1:]
            continue
        two = False
        if d < _BK * lam:
            row = np.abs(m[:, p])
            row[p] = 0
            sigma = row.max()
            if d * sigma < _BK * lam * lam:
                two = abs(m[p, p]) < _BK * sigma
                to = 1 if two else 0
                if p != to:
                    m[[to, p]] = m[[p, to]]
                    m[:, [to, p]] = m[:, [p, to]]
        if two:
            above += 1  # such a block has one pivot of each sign
            c = m[2:, :2]
            m = m[2:, 2:] - c @ np.linalg.solve(m[:2, :2], c.T)
        else:
            above += int(m[0, 0] > 0)
            c = m[1:, 0]
            m = m[1:, 1:] - np.outer(c, c / m[0, 0])
    return above


class Slices:
    """Shifts with the number of eigenvalues above them."""

    def __init__(self, a: np.ndarray) -> None:
        self.a = a
        radius = np.abs(a).sum(axis=1) - np.abs(a.diagonal())
        low, high = float((a.diagonal() - radius).min()), float((a.diagonal() + radius).max())
        wide = max(high - low, abs(high), abs(low), 1e-300)
        self.least = 4 * np.finfo(float).eps * wide
        self.known = {low - 1e-6 * wide: len(a), high + 1e-6 * wide: 0}

    def count(self, shift: float) -> int:
        if shift not in self.known:
            self.known[shift] = count_above(self.a, shift)
        return self.known[shift]

    def interval(self, k: int) -> tuple[float, float]:
        """The narrowest known interval that holds the k-th eigenvalue from above."""
        return max(s for s, n in self.known.items() if n >= k), min(s for s, n in self.known.items() if n < k)

    def halve(self, k: int) -> bool:
        """Halves the k-th one's interval; false where no double lies between its ends to tell them apart."""
        low, high = self.interval(k)
        mid = low + (high - low) / 2
        if high - low <= self.least or not low < mid < high:
            return False
        self.count(mid)
        return True

    def alone(self, k: int) -> bool:
        low, high = self.interval(k)
        return self.known[low] == k and self.known[high] == k - 1


def _solve(a: np.ndarray, shift: float, y: np.ndarray, step: float) -> np.ndarray:
    """A step of inverse iteration; a shift that is an eigenvalue to the last bit is moved a little."""
    for _ in range(60):
        try:
            z = np.linalg.solve(a - shift * np.eye(len(a)), y)
        except np.linalg.LinAlgError:
            z = np.full(len(a), np.inf)
        if np.isfinite(z).all():
            return z / np.linalg.norm(z)
        shift, step = shift + step, 2 * step
    raise ArithmeticError("no shift near an eigenvalue can be solved")


def leading(a: np.ndarray, most: int = COMPONENTS, no_direction: float = NO_DIRECTION) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvalues, falling, and unit eigenvectors (as columns) of a symmetric matrix."""
    if not a.any():
        return np.empty(0), np.empty((len(a), 0))
    unit = 2.0 ** math.frexp(np.abs(a).max())[1]  # scaling by a power of two is exact
    a = a / unit
    slices = Slices(a)
    random = np.random.Generator(np.random.PCG64(1))
    values, vectors = [], []
    for k in range(1, min(most, len(a)) + 1):
        while not slices.alone(k) and slices.halve(k):
            pass
        before = np.array(vectors).T if vectors else np.empty((len(a), 0))
        clear = lambda y: y - before @ (before.T @ y)  # noqa: B023, E731
        while True:
            low, high = slices.interval(k)
            shift = low + (high - low) / 2
            y = clear(random.standard_normal(len(a)))
            for _ in range(3):  # fixed shift: the vectors of the interval outgrow the others
                y = clear(_solve(a, shift, y, slices.least))
                y /= np.linalg.norm(y)
            value, rest = float(y @ a @ y), math.inf
            for _ in range(12):
                # an iteration whose quotient has left the interval is another eigenvalue's
                if not low - slices.least <= value <= high + slices.least:
                    break
                now = float(np.linalg.norm(a @ y - value * y))
                if now >= rest / 2:
                    break
                rest = now
                z = clear(_solve(a, value, y, slices.least))
                z /= np.linalg.norm(z)
                y, value = z, float(z @ a @ z)
            inside = low - slices.least <= value <= high + slices.least
            if inside and slices.count(value - 8 * slices.least) >= k and slices.count(value + 8 * slices.least) < k:
                break
            if not slices.halve(k):
                break  # the interval is as narrow as doubles allow, which certifies the number as well
        if values and value <= no_direction * values[0] or value <= 0:
            break
        values.append(value)
        vectors.append(y)
    return np.array(values) * unit, np.array(vectors).T if vectors else np.empty((len(a), 0))


@dataclass(frozen=True)
class Fit:
    """What whitening needs of the fit list; ``sums`` are exact, ``base`` their floored mean."""

    n: int
    sums: tuple[int, ...]
    base: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n * x - sum)**2, null beyond a long."""
        d, rest = x - self.base, np.array([s - self.n * int(b) for s, b in zip(self.sums, self.base, strict=True)], dtype=object)
        if not d.size:
            return [0] * len(x)
        most = self.n * (int(np.abs(d).max()) + 1)
        if most * most * d.shape[1] < 1 << 62:
            y = self.n * d - rest.astype(np.int64)
            return (y * y).sum(axis=1).tolist()
        y = self.n * d.astype(object) - rest
        return [v if v < 1 << 63 else None for v in (y * y).sum(axis=1)]

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Rows minus the mean, on the components, each of variance 1."""
        rest = np.array([(s - self.n * int(b)) / self.n for s, b in zip(self.sums, self.base, strict=True)])
        return ((x - self.base) - rest) @ (self.vectors / np.sqrt(self.values))


def _wide(column: pa.Array, width: int) -> np.ndarray:
    """Integers of rows; missing entries are 0 before the shift."""
    return matrix_of(column, width) + SHIFT


def fit(kept: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Exact sums and the eigenvectors over all rows of (vec_id, x); None without rows."""
    n = kept.count()
    if not n:
        return None
    each = kept.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s")).collect()
    width = max((i for i, _ in each), default=-1) + 1
    sums = [n * SHIFT] * width
    for i, s in each:
        sums[i] += int(s)
    base = np.array([s // n for s in sums], dtype=np.int64)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width), dtype=object)
        for batch in batches:
            x = _wide(batch.column(0), width)
            for a in range(0, len(x), 4096):
                d = x[a : a + 4096] - base
                exact = int(np.abs(d).max(initial=0)) ** 2 * len(d) < 1 << 53
                d = d.astype(np.float64 if exact else object)
                p = d.T @ d
                total += p.astype(np.int64).astype(object) if exact else p
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array([str(v) for v in total[i, j]], pa.string())], ["i", "j", "p"])

    got = kept.select("x").mapInArrow(products, "i long, j long, p string").groupBy("i", "j").agg(F.sum(F.col("p").cast("decimal(38,0)")).alias("p")).collect()
    rest = [s - n * int(b) for s, b in zip(sums, base, strict=True)]
    v = np.zeros((width, width))
    for i, j, p in got:
        v[i, j] = v[j, i] = (n * int(p) - rest[i] * rest[j]) / (n * n)
    values, vectors = leading(v, components)
    return Fit(n, tuple(sums), base, values, vectors, float(v.trace()))


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every whole row and component.

    ``vectors`` needs vec_id (long) and embedding. ``identity_error`` is measured on the whitened rows.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    held = lambda c: F.greatest(F.least(F.floor(c.cast("double") * F.lit(float(SCALE))), F.lit(MOST)), F.lit(-MOST))
    kept = staged(whole_vectors(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", held).alias("x")), "whitening")
    f = fit(kept, components)
    if f is None or not len(f.values):
        return vectors.sparkSession.createDataFrame([], schema)
    count, width = len(f.values), len(f.sums)
    i, j = np.triu_indices(count)

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, means = np.zeros((count, count)), np.zeros(count)
        for batch in batches:
            y = f.whiten(_wide(batch.column(0), width))
            total += y.T @ y
            means += y.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "p"])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(count)), pa.array(np.full(count, -1)), pa.array(means)], ["i", "j", "p"])

    got = {(i, j): p for i, j, p in kept.select("x").mapInArrow(squares, "i long, j long, p double").groupBy("i", "j").agg(F.sum("p")).collect()}
    error = max(abs(p / f.n - got[i, -1] * got[j, -1] / f.n**2 - (i == j)) for (i, j), p in got.items() if j >= 0)
    explained = f.values / f.trace

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _wide(batch.column(1), width)
            m = len(x)
            owner = np.repeat(np.arange(m), count)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(owner)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)), pa.array(np.full(m * count, f.n)),
                    pa.array(f.deviations(x), pa.int64()).take(pa.array(owner)), pa.array(f.whiten(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * count, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return kept.select("vec_id", "x").mapInArrow(rows, schema)
