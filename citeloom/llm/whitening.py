"""Whitening of embeddings: principal components of a distributed covariance, scaled to unit variance.

Vectors become whole numbers x = floor(``STEPS`` * c) + ``OFFSET``, so counts and sums are exact. Three scans fit and check:
sums per dimension; the covariance of entries centred on the exact mean before they are multiplied; the covariance of the whitened
vectors. Each task reduces its vectors to one array, and arrays are added by Spark per position, so what reaches the driver
has the size of one covariance matrix, whatever the table holds.

The matrix is made tridiagonal by Householder reflections. Sturm counts, the number of negative pivots of T - e, bisect the leading
eigenvalues. Inverse iteration finds their vectors; within a cluster of close eigenvalues each vector is made
orthogonal to those before it. The reflections carry them back, and tasks project with the broadcast components.

Edge cases: rows whose vector is null or holds a null, NaN or infinite entry are left out. A shorter vector counts as if it ended
in zeros. Entries of 2^40 and beyond are an error, because sums would no longer be exact. Repeated rows and equal ids count one
by one, a null id too. Eigenvalues that are zero by rounding (constant dimensions, fewer vectors than dimensions) give no
component; a table of equal vectors has none. Tied eigenvalues give some orthonormal basis, the same for all rows. An empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS, OFFSET = 64, 1_000_000
COMPONENTS = 32
LARGEST = float(2**40)
CLOSE = 1e-3  # eigenvalues this near, relative to the largest, form a cluster
ZERO = 1e-11
EPS = np.finfo(float).eps


# --- symmetric eigenproblem --------------------------------------------------------------------------------------


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflections) of a symmetric matrix; reflection i acts on the entries from i + 1 on."""
    a, n, reflections = a.copy(), len(a), []
    for i in range(n - 2):
        v = a[i + 1 :, i].copy()
        length = np.sqrt(v @ v)
        v[0] += np.copysign(length, v[0])
        size = np.sqrt(v @ v)
        if size == 0.0:
            reflections.append(np.zeros_like(v))
            continue
        v /= size
        block = a[i + 1 :, i + 1 :]
        p = block @ v
        w = p - (p @ v) * v
        block -= 2.0 * (np.outer(v, w) + np.outer(w, v))
        a[i + 1 :, i] = a[i, i + 1 :] = 0.0
        a[i + 1, i] = a[i, i + 1] = -np.copysign(length, v[0])
        reflections.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, points: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each point."""
    least = EPS * max(1e-300, np.abs(diagonal).max(initial=0.0) + np.abs(off).max(initial=0.0))
    pivot = diagonal[0] - points
    below = (pivot < 0).astype(np.int64)
    for d, o in zip(diagonal[1:], off, strict=True):
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        pivot = d - points - o * o / pivot
        below += pivot < 0
    return below


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The largest ``count`` eigenvalues, falling, by bisection of all of them at once."""
    n = len(diagonal)
    reach = np.abs(np.concatenate(([0.0], off))) + np.abs(np.concatenate((off, [0.0])))
    low = np.full(count, (diagonal - reach).min())
    high = np.full(count, (diagonal + reach).max())
    spread = max(high[0] - low[0], 1e-300)
    low, high = low - 1e-3 * spread, high + 1e-3 * spread
    wanted = n - np.arange(count)  # as many eigenvalues lie below anything above the i-th
    for _ in range(200):
        middle = 0.5 * (low + high)
        if np.all((middle <= low) | (middle >= high)):
            break
        above = sturm_counts(diagonal, off, middle) >= wanted
        high, low = np.where(above, middle, high), np.where(above, low, middle)
    return 0.5 * (low + high)


def _solved(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """x of (T - shift) x = right, by elimination with row exchanges."""
    n = len(diagonal)
    main, upper, second = diagonal - shift, np.append(off, 0.0), np.zeros(n)
    x = right.copy()
    for i in range(n - 1):
        if abs(off[i]) > abs(main[i]):
            factor = main[i] / off[i]
            main[i], upper[i], main[i + 1], next_upper = off[i], main[i + 1], upper[i] - factor * main[i + 1], upper[i + 1]
            second[i], upper[i + 1] = next_upper, -factor * next_upper
            x[i], x[i + 1] = x[i + 1], x[i] - factor * x[i + 1]
        else:
            if abs(main[i]) < least:
                main[i] = least
            factor = off[i] / main[i]
            main[i + 1] -= factor * upper[i]
            x[i + 1] -= factor * x[i]
    if abs(main[-1]) < least:
        main[-1] = least
    x[-1] /= main[-1]
    for i in range(n - 2, -1, -1):
        x[i] = (x[i] - upper[i] * x[i + 1] - (second[i] * x[i + 2] if i + 2 < n else 0.0)) / main[i]
    return x


def tridiagonal_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors, one row per value; within a cluster each is orthogonal to those before it."""
    scale = max(1e-300, np.abs(diagonal).max(initial=0.0) + 2 * np.abs(off).max(initial=0.0))
    found, cluster = np.zeros((len(values), len(diagonal))), 0
    draw = np.random.default_rng(7)
    for i, value in enumerate(values):
        if i and values[i - 1] - value > CLOSE * scale:
            cluster = i
        shift = value - (i - cluster) * 2 * EPS * scale  # apart, so that equal eigenvalues see different systems
        x = draw.standard_normal(len(diagonal))
        for _ in range(6):
            x = _solved(diagonal, off, shift, x / np.abs(x).max(), EPS * scale)
            x /= np.abs(x).max()
            for _ in range(2):
                x -= found[cluster:i].T @ (found[cluster:i] @ x)
            x /= np.sqrt(x @ x)
        found[i] = x
    return found


def leading_components(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors in rows) of a symmetric matrix, falling; those that are zero by rounding are left out."""
    n = len(matrix)
    count = min(count, n)
    if count == 0 or not np.abs(matrix).max():
        return np.zeros(0), np.zeros((0, n))
    diagonal, off, reflections = tridiagonal(matrix)
    values = leading_eigenvalues(diagonal, off, count)
    values = values[values > ZERO * values[0]] if values[0] > 0 else values[:0]
    vectors = tridiagonal_vectors(diagonal, off, values)
    for i in range(len(reflections) - 1, -1, -1):
        part = vectors[:, i + 1 :]
        part -= 2.0 * np.outer(part @ reflections[i], reflections[i])
    # Nothing but rounding separates them from an orthonormal set; one more pass removes that.
    for i in range(len(vectors)):
        vectors[i] -= vectors[:i].T @ (vectors[:i] @ vectors[i])
        vectors[i] /= np.sqrt(vectors[i] @ vectors[i])
    return values, vectors


# --- distributed sums --------------------------------------------------------------------------------------------


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    entry = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, entry)


def _entries(vectors: pa.ListArray, dims: int) -> np.ndarray:
    """floor(STEPS * c) of every entry as whole numbers, shorter vectors ended by zeros."""
    lengths = np.asarray(vectors.value_lengths())
    flat = np.asarray(vectors.flatten(), np.float64)
    scaled = np.floor(STEPS * flat)
    if len(scaled) and np.abs(scaled).max() >= LARGEST:
        raise ValueError(f"an entry of {flat[np.abs(scaled).argmax()]} is too large for exact sums")
    out = np.zeros((len(lengths), dims), np.int64)
    if len(flat) == out.size and (lengths == dims).all():
        out[:] = scaled.reshape(out.shape)
    else:
        out[np.arange(dims) < lengths[:, None]] = scaled
    return out


def _added(vectors: DataFrame, column: str, dims: int, reduce: Callable[[np.ndarray], np.ndarray], kind: str, size: int) -> list:
    """The sum over all vectors of the array that ``reduce`` makes of a block of them: one array leaves a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            block = reduce(_entries(batch.column(0), dims))
            total = block if total is None else total + block
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.int64() if kind == "long" else pa.float64()))], ["part"])

    parts = vectors.select(F.col(column)).mapInArrow(run, f"part array<{kind}>")
    rows = parts.select(F.posexplode("part").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = [0] * size
    for row in rows:
        out[row["at"]] = row["value"]
    return out


@dataclass(frozen=True)
class Model:
    n: int
    sums: tuple[int, ...]  # of x per dimension, exact
    values: np.ndarray
    vectors: np.ndarray  # one component per row
    trace: float

    @property
    def dims(self) -> int:
        return len(self.sums)

    def _base(self) -> tuple[np.ndarray, np.ndarray]:
        """A whole number near the mean of floor(STEPS * c) per dimension, and n times what is left of the mean."""
        plain = [s - self.n * OFFSET for s in self.sums]
        near = [s // self.n for s in plain]
        return np.array(near, np.int64), np.array([s - self.n * b for s, b in zip(plain, near, strict=True)], np.int64)

    def centred(self, entries: np.ndarray) -> np.ndarray:
        """x - S/n, rounded once."""
        near, rest = self._base()
        return (entries - near) - rest / self.n

    def whitened(self, entries: np.ndarray) -> np.ndarray:
        return self.centred(entries) @ (self.vectors / np.sqrt(self.values)[:, None]).T

    def deviations(self, entries: np.ndarray) -> list[Decimal]:
        """The sums over the dimensions of (n x - S)^2, exact."""
        near, rest = self._base()
        moved = entries - near
        most = max(int(np.abs(moved).max(initial=0)), self.n)
        if most * int(np.abs(moved).max(initial=0)) * self.dims >= 2**63:
            moved, rest = moved.astype(object), rest.astype(object)
        squares, crossed, fixed = (moved * moved).sum(axis=1), (moved * rest).sum(axis=1), sum(int(r) ** 2 for r in rest)
        return [Decimal(self.n**2 * int(a) - 2 * self.n * int(b) + fixed) for a, b in zip(squares, crossed, strict=True)]


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Model:
    """The components of all usable vectors of the table."""
    used = vectors.where(usable(F.col(column)))
    n, dims = used.agg(F.count(F.lit(1)), F.max(F.size(column))).first()
    if not n or not dims:
        return Model(n, (0,) * (dims or 0), np.zeros(0), np.zeros((0, dims or 0)), 0.0)
    plain = _added(used, column, dims, lambda x: x.sum(axis=0), "long", dims)
    mean = Model(n, tuple(s + n * OFFSET for s in plain), np.zeros(0), np.zeros((0, dims)), 0.0)
    upper = np.triu_indices(dims)

    def products(x: np.ndarray) -> np.ndarray:
        y = mean.centred(x)
        return (y.T @ y)[upper]

    covariance = np.zeros((dims, dims))
    covariance[upper] = np.array(_added(used, column, dims, products, "double", len(upper[0]))) / n
    covariance += np.triu(covariance, 1).T
    values, found = leading_components(covariance, components)
    return Model(n, mean.sums, values, found, float(np.trace(covariance)))


def identity_error(vectors: DataFrame, model: Model, column: str = "embedding") -> float:
    """The largest absolute entry of the covariance of the whitened vectors minus the identity, measured over all of them."""
    k = len(model.values)
    if not k:
        return 0.0
    used = vectors.where(usable(F.col(column)))

    def sums(x: np.ndarray) -> np.ndarray:
        return model.whitened(x).sum(axis=0)

    mean = np.array(_added(used, column, model.dims, sums, "double", k)) / model.n

    def products(x: np.ndarray) -> np.ndarray:
        z = model.whitened(x) - mean
        return (z.T @ z).ravel()

    covariance = np.array(_added(used, column, model.dims, products, "double", k * k)).reshape(k, k) / model.n
    return float(np.abs(covariance - np.eye(k)).max())


def whiten(vectors: DataFrame, model: Model, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, deviation, whitened) of every usable vector. ``deviation``: exact sum of (n x - S)^2; ``whitened``: one entry per
    component, in the order of the model."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # as large as the covariance at most
    k = len(model.values)
    kind = pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            x = _entries(batch.column(1), found.dims)
            whitened = found.whitened(x) if k else np.zeros((len(x), 0))
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * k, pa.array(whitened.ravel()))
            deviation = pa.array(found.deviations(x), pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, lists.cast(kind)], [id_col, "deviation", "whitened"])

    used = vectors.where(usable(F.col(column)))
    schema = f"`{id_col}` {vectors.schema[id_col].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>"
    return used.select(id_col, column).mapInArrow(run, schema)
