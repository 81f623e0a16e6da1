"""Whitening of embedding vectors on their leading principal components.

Entries become whole numbers, floor(256 c). The fit list holds each distinct vector once. One pass sums it, a second one
adds up products of centred vectors, task by task; the covariance, a table of dimensions by dimensions, is all that the
driver holds. There it is made tridiagonal by Householder reflections; Sturm counts bisect the leading eigenvalues;
inverse iteration gives their vectors, each made orthogonal to the ones before it whose eigenvalues lie near. The
components go to all tasks, which project every row. A third pass over the fit list measures what is left to the
identity in the covariance of the whitened values.

Rows: null vectors and those with null or non-finite entries are dropped, and so are empty ones and those whose length
isn't that of most distinct vectors (the longest of several). Entries beyond a 64-bit number are held at its ends.
Repeated rows, null ids and equal vectors are projected each for itself. A component without variance (no more than
the rounding error of the largest) has no whitened values and isn't returned; so one vector, or an empty table, gives no
rows. Deviations are exact; one beyond a 64-bit number is null. Ties among eigenvalues give any base of their space,
the same for all rows; signs make the largest entry positive. Other columns go.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, map_batches

SCALE = 256
COMPONENTS = 4
NEAR = 1e-3  # eigenvalues nearer than this share of the norm are made orthogonal to each other
_LONG = 1 << 63


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and off-diagonal of a symmetric matrix after Householder reflections, and the reflections' vectors."""
    a, n = np.array(a, np.float64), len(a)
    mirrors = []
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        length = np.sqrt(v @ v)
        v[0] += np.copysign(length, v[0])
        size = np.sqrt(v @ v)
        v = v / size if size else v
        mirrors.append(v)
        rest = a[k + 1 :, k + 1 :]
        w = rest @ v
        w = 2 * (w - (v @ w) * v)
        rest -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
    return a.diagonal().copy(), np.diagonal(a, -1).copy(), mirrors


def below(diagonal: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For each x: how many eigenvalues of the tridiagonal matrix are less (signs of its Sturm sequence)."""
    squares = off * off
    least = 4 * np.finfo(np.float64).tiny * max(1.0, squares.max(initial=0.0))  # a quotient of these is finite
    count, q = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    for k in range(len(diagonal)):
        q = diagonal[k] - x - (squares[k - 1] / q if k else 0.0)
        q = np.where(np.abs(q) < least, -least, q)
        count += q < 0
    return count


def leading(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each bisected until its bounds are neighbours."""
    n = len(diagonal)
    reach = np.abs(np.append(off, 0)) + np.abs(np.append(0, off))
    low, high = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max())
    pad = np.finfo(np.float64).eps * max(abs(low[0]), abs(high[0])) * n
    low, high = low - pad, high + pad
    want = n - 1 - np.arange(k)  # so many are less than it
    while True:
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            return middle
        less = below(diagonal, off, middle) > want
        open_ = (middle > low) & (middle < high)
        high, low = np.where(open_ & less, middle, high), np.where(open_ & ~less, middle, low)


def _solved(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, floor: float) -> np.ndarray:
    """x of (T - shift) x = b, by elimination with row exchanges; pivots are floor at least."""
    n = len(diagonal)
    u, v, w = np.zeros(n), np.zeros(n), np.zeros(n)  # three diagonals of the upper factor
    x = b.copy()
    p, q = diagonal[0] - shift, off[0] if n > 1 else 0.0
    for k in range(n - 1):
        c, d, e = off[k], diagonal[k + 1] - shift, off[k + 1] if k + 2 < n else 0.0
        if abs(c) > abs(p):
            u[k], v[k], w[k] = c, d, e
            f = p / c
            p, q = q - f * d, -f * e
            x[k], x[k + 1] = x[k + 1], x[k] - f * x[k + 1]
        else:
            p = p if abs(p) >= floor else floor
            u[k], v[k], w[k] = p, q, 0.0
            f = c / p
            p, q = d - f * q, e
            x[k + 1] -= f * x[k]
    u[-1] = p if abs(p) >= floor else floor
    for k in range(n - 1, -1, -1):
        x[k] = (x[k] - (v[k] * x[k + 1] if k + 1 < n else 0.0) - (w[k] * x[k + 2] if k + 2 < n else 0.0)) / u[k]
        if abs(x[k]) > 1e150:
            x /= abs(x[k])  # both sides of what is yet to be solved; only the direction matters
    return x


def vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors, as columns, of falling eigenvalues: inverse iteration, orthogonal within clusters."""
    n = len(diagonal)
    norm = max(np.abs(diagonal).max(), np.abs(off).max() if n > 1 else 0.0, np.finfo(np.float64).tiny)
    eps = np.finfo(np.float64).eps
    out = np.zeros((n, len(values)))
    random = np.random.default_rng(1)
    shift = np.inf
    for k, value in enumerate(values):
        shift = min(value, shift - 2 * eps * norm)  # equal ones apart, or they would give equal vectors
        cluster = [j for j in range(k) if values[j] - value <= NEAR * norm]
        x = random.standard_normal(n)
        for _ in range(5):
            for _ in range(2):
                for j in cluster:
                    x -= (out[:, j] @ x) * out[:, j]
            x /= np.sqrt(x @ x)
            x = _solved(diagonal, off, shift, x, eps * norm)
            x /= np.abs(x).max()
        for _ in range(2):
            for j in cluster:
                x -= (out[:, j] @ x) * out[:, j]
        out[:, k] = x / np.sqrt(x @ x)
    return out


def components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvalues, falling, and their unit vectors as columns; those without variance left out."""
    n = len(covariance)
    diagonal, off, mirrors = tridiagonal(covariance)
    values = leading(diagonal, off, min(most, n))
    values = values[values > 4 * n * np.finfo(np.float64).eps * max(values[0], 0.0)]
    columns = vectors(diagonal, off, values)
    for k in range(len(mirrors) - 1, -1, -1):
        v = mirrors[k]
        columns[k + 1 :] -= 2 * np.outer(v, v @ columns[k + 1 :])
    largest = columns[np.abs(columns).argmax(0), np.arange(len(values))] if len(values) else np.ones(0)
    return values, columns * np.sign(largest)


def whole(column: pa.ListArray, width: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row numbers of usable vectors of a batch, and their whole numbers. width: no other length is usable."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    starts, sizes = offsets[:-1], np.diff(offsets)
    entries = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])
    good = (sizes > 0) & (bad[starts + sizes] == bad[starts])
    if column.null_count:
        good &= column.is_valid().to_numpy(zero_copy_only=False)
    if width is not None:
        good &= sizes == width
    rows = np.flatnonzero(good)
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(SCALE * np.where(np.isfinite(entries), entries, 0.0))
    numbers = np.where(scaled >= float(_LONG), _LONG - 1, np.clip(scaled, -float(_LONG), float(_LONG - 1024)).astype(np.int64))
    if width is not None:
        return rows, numbers[starts[rows][:, None] + np.arange(width)] if len(rows) else np.zeros((0, width), np.int64)
    return rows, [numbers[a : a + s] for a, s in zip(starts[rows], sizes[rows], strict=True)]


@dataclass
class Model:
    """n vectors of the fit list and their sums; eigenvalues, unit vectors as columns, the covariance's trace, and the
    largest entry by which the whitened fit list's covariance differs from the identity."""

    n: int
    sums: list[int]
    values: np.ndarray
    columns: np.ndarray
    trace: float
    identity_error: float = 0.0

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - sums, exact: 64-bit numbers where their squares' sum fits, else Python's."""
        most = self.n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, self.sums), default=0)
        if most * most * max(1, x.shape[1]) < _LONG:
            return x * np.int64(self.n) - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        return (deviations.astype(np.float64) / self.n) @ self.columns / np.sqrt(self.values)


def _added(parts: DataFrame) -> list[list]:
    """Sums of (at, a, b) by place: a table whose size doesn't hang on the rows."""
    return [[r.at, r.a, r.b] for r in parts.groupBy("at").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()]


def fitted(table: DataFrame, column: str = "embedding", most: int = COMPONENTS) -> Model | None:
    """The model of a table's vectors; None if none is usable."""

    def listed(batches) -> Iterator[list]:
        for batch in batches:
            yield [pa.array(whole(batch.column(0))[1], pa.list_(pa.int64()))]

    own = map_batches(table.select(column), listed, "x array<long>")
    fit = kept(own.distinct(), "whitening-fit")
    widths = fit.groupBy(F.size("x").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).first()
    if not widths:
        return None
    width, n = widths.w, widths["count"]
    fit = fit.filter(F.size("x") == width)

    def matrices(batches) -> Iterator[np.ndarray]:
        for batch in batches:
            values = pa.array(batch.column(0))
            yield values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), width)

    def summed(batches) -> Iterator[list]:
        high, low = np.zeros(width, np.int64), np.zeros(width, np.int64)
        for x in matrices(batches):  # in two halves: no sum leaves 64 bits
            high += (x >> 32).sum(0)
            low += (x & 0xFFFFFFFF).sum(0)
        yield [np.arange(width), high, low]

    sums = [0] * width
    for at, a, b in _added(map_batches(fit, summed, "at long, a long, b long")):
        sums[at] = (a << 32) + b
    model = Model(n, sums, np.zeros(0), np.zeros((width, 0)), 0.0)

    def products(batches) -> Iterator[list]:
        total = np.zeros((width, width))
        for x in matrices(batches):
            d = model.deviations(x).astype(np.float64) / n
            total += d.T @ d
        at = np.triu_indices(width)
        yield [at[0] * width + at[1], total[at], np.zeros(len(at[0]))]

    covariance = np.zeros(width * width)
    for at, a, _ in _added(map_batches(fit, products, "at long, a double, b double")):
        covariance[at] = a / n
    covariance = covariance.reshape(width, width)
    covariance = np.triu(covariance) + np.triu(covariance, 1).T
    model.trace = float(np.trace(covariance))
    if model.trace > 0:
        model.values, model.columns = components(covariance, most)
    k = len(model.values)

    def remaining(batches) -> Iterator[list]:
        total, first = np.zeros((k, k)), np.zeros(k)
        for x in matrices(batches):
            y = model.whitened(model.deviations(x))
            total += y.T @ y
            first += y.sum(0)
        yield [np.arange(k * k + k), np.concatenate([total.ravel(), first]), np.zeros(k * k + k)]

    if k:
        seen = np.zeros(k * k + k)
        for at, a, _ in _added(map_batches(fit, remaining, "at long, a double, b double")):
            seen[at] = a / n
        own_covariance = seen[: k * k].reshape(k, k) - np.outer(seen[k * k :], seen[k * k :])
        model.identity_error = float(np.abs(own_covariance - np.eye(k)).max())
    return model


def projected(table: DataFrame, model: Model | None, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """A row for each usable vector and component: (key, component, n, deviation, whitened, explained, identity_error)."""
    schema = f"{key} long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    own = table.select(F.col(key).cast("long").alias(key), column)
    if model is None or not len(model.values):
        return own.sparkSession.createDataFrame([], schema)
    width, k = model.columns.shape
    explained = model.values / model.trace

    def run(batches) -> Iterator[list]:
        for batch in batches:
            rows, x = whole(batch.column(1), width)
            d = model.deviations(x)
            squares = [v if v < _LONG else None for v in (d * d).sum(1).tolist()]
            ids = batch.column(0).take(pa.array(np.repeat(rows, k)))
            m = len(rows)
            yield [ids, np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, model.n), pa.array([v for v in squares for _ in range(k)], pa.int64()), model.whitened(d).ravel(), np.tile(explained, m), np.full(m * k, model.identity_error)]

    return map_batches(own, run, schema)


def report(table: DataFrame) -> DataFrame:
    return projected(table, fitted(table))
