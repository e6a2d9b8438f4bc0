"""Whitening of vectors on the leading components of their covariance.

Vectors become whole numbers (floor of 256 times each entry). The distinct ones
are written once; tasks add up exact sums, then products of centred vectors, one
matrix a task, and Spark adds the matrices. Only the d x d covariance reaches
the driver: Householder reflections make it tridiagonal, bisection on Sturm
counts finds the leading eigenvalues, inverse iteration, reorthogonalised among
close eigenvalues, their vectors. Mean and components are broadcast and every
row is projected where it lies.

A task's matrix is as large as d of its own rows, so what is shuffled stays a
small part of the input at any size.

Defined cases: rows whose vector is null or holds null or non-finite entries go;
of the others those of the commonest length are used (of equally common ones the
greatest), empty vectors and other lengths go; whole numbers beyond 64 bits
saturate; a null id stays; repeated rows are projected each and fitted once;
components without variance (below 1e-12 of the first) are not returned, so equal
vectors, one vector or an empty table give no row; a deviation beyond 64 bits is
null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowferry.errors import ConfigError
from rowferry.scratch import materialize

SCALE = 256
COMPONENTS = 4
#: The driver holds one square matrix of this many rows at most.
MAX_LENGTH = 2048
#: Components whose eigenvalue is a smaller part of the first have no variance.
LEAST_PART = 1e-12
#: Eigenvalues closer than this part of the matrix's norm have their vectors made orthogonal.
CLUSTER = 1e-3
#: Rows of a batch that a task works on at a time.
SLICE = 1024


@dataclass(frozen=True)
class Fit:
    """n distinct vectors with sums by dimension; eigenvalues and unit vectors (rows) by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    trace: float
    values: np.ndarray
    vectors: np.ndarray


def codes(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x) of rows with a finite vector; x is an array of longs."""
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    kept = table.where(F.col(vector_col).isNotNull() & finite & (F.size(vector) > 0))
    return kept.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(vector, lambda c: F.floor(c * SCALE).cast("long")).alias("x"),
    )


def commonest_length(coded: DataFrame) -> int:
    """0 where there is no row."""
    counts = coded.groupBy(F.size("x").alias("d")).count()
    first = counts.orderBy(F.desc("count"), F.desc("d")).first()
    return first["d"] if first else 0


def _blocks(batches: Iterable[pa.RecordBatch], column: int, length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with their vectors as a matrix of longs."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def _exact(x: np.ndarray, greatest: int) -> np.ndarray:
    """x as Python integers where results as great as this would not fit in 64 bits."""
    return x if greatest < 1 << 62 else x.astype(object)


def _most(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min())))


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - sums, exact."""
    if n * _most(x) + max(map(abs, sums)) < 1 << 62:
        return x * np.int64(n) - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def totals(vectors: DataFrame, length: int) -> tuple[int, tuple[int, ...]]:
    """Number of vectors and their exact sums by dimension."""
    schema = pa.schema([("dim", pa.int32()), ("total", pa.string()), ("n", pa.int64())])

    def task(batches):
        n, sums = 0, [0] * length
        for _, x in _blocks(batches, 0, length):
            n += len(x)
            sums = [a + int(b) for a, b in zip(sums, _exact(x, _most(x) * len(x)).sum(axis=0))]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(length), pa.int32()), pa.array(map(str, sums)), pa.array([n] * length)], schema=schema
            )

    parts = vectors.mapInArrow(task, "dim int, total string, n long")
    rows = parts.groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect()
    by = {r["dim"]: r for r in rows}
    return (by[0]["n"], tuple(int(by[i]["s"]) for i in range(length))) if by else (0, ())


def covariance(vectors: DataFrame, length: int, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """Mean of the products of centred vectors; tasks send the upper triangle of their sum."""
    schema = pa.schema([("cell", pa.int32()), ("total", pa.float64())])
    upper = np.triu_indices(length)
    cells = (upper[0] * length + upper[1]).astype(np.int32)

    def task(batches):
        total, seen = np.zeros((length, length)), False
        for _, x in _blocks(batches, 0, length):
            y = (centred(x, n, sums) / n).astype(np.float64)
            total += y.T @ y
            seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[upper])], schema=schema)

    parts = vectors.mapInArrow(task, "cell int, total double")
    found = parts.groupBy("cell").agg((F.sum("total") / n).alias("mean")).toPandas()
    out = np.zeros((length, length))
    out.flat[found["cell"].to_numpy()] = found["mean"].to_numpy()
    return np.triu(out) + np.triu(out, 1).T


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, the line beside it, and the unit vectors of the reflections that lead there."""
    a, mirrors = matrix.copy(), []
    for k in range(len(a) - 2):
        u = a[k + 1:, k].copy()
        u[0] += np.copysign(np.linalg.norm(u), u[0])
        size = np.linalg.norm(u)
        u = u / size if size else u
        mirrors.append(u)
        rest = a[k + 1:, k + 1:]
        p = rest @ u
        q = p - (u @ p) * u
        rest -= 2 * (np.outer(u, q) + np.outer(q, u))
        a[k + 1:, k] -= 2 * u * (u @ a[k + 1:, k])
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def reflected(vector: np.ndarray, mirrors: list[np.ndarray]) -> np.ndarray:
    """A vector of the tridiagonal matrix as one of the matrix it was made of."""
    out = vector.copy()
    for k in range(len(mirrors) - 1, -1, -1):
        u = mirrors[k]
        out[k + 1:] -= 2 * u * (u @ out[k + 1:])
    return out


def sturm_count(diagonal: np.ndarray, beside: np.ndarray, at: np.ndarray, tiny: float) -> np.ndarray:
    """How many eigenvalues lie below each number: negative pivots of the shifted matrix."""
    pivot = diagonal[0] - at
    below = (pivot < 0).astype(int)
    for d, e in zip(diagonal[1:], beside):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = d - at - e * e / pivot
        below += pivot < 0
    return below


def leading_values(diagonal: np.ndarray, beside: np.ndarray, k: int) -> np.ndarray:
    """The k greatest eigenvalues, falling, by bisection down to neighbouring doubles."""
    reach = np.abs(np.concatenate([[0], beside])) + np.abs(np.concatenate([beside, [0]]))
    bound = max(float(np.max(np.abs(diagonal) + reach)), np.finfo(float).tiny)
    tiny = bound * np.finfo(float).eps ** 2
    low, high = np.full(k, -bound * 1.001), np.full(k, bound * 1.001)
    wanted = len(diagonal) - np.arange(k)  # as many lie below a number just above the value
    for _ in range(200):
        middle = low + (high - low) / 2
        if np.all((middle <= low) | (middle >= high)):
            break
        above = sturm_count(diagonal, beside, middle, tiny) >= wanted
        high, low = np.where(above, middle, high), np.where(above, low, middle)
    return high


def _solved(diagonal: np.ndarray, beside: np.ndarray, shift: float, right: np.ndarray, tiny: float) -> np.ndarray:
    """(T - shift) y = right, by elimination with row exchanges; a vanishing pivot counts as tiny."""
    n = len(diagonal)
    d, up, far = (diagonal - shift).tolist(), [*beside.tolist(), 0.0], [0.0] * n
    low, y = beside.tolist(), right.tolist()
    for i in range(n - 1):
        below = low[i]
        if abs(below) > abs(d[i]):  # the next row becomes the pivot row
            d[i], below = below, d[i]
            up[i], d[i + 1] = d[i + 1], up[i]
            far[i], up[i + 1] = up[i + 1], 0.0
            y[i], y[i + 1] = y[i + 1], y[i]
        d[i] = d[i] if abs(d[i]) > tiny else tiny
        factor = below / d[i]
        d[i + 1] -= factor * up[i]
        up[i + 1] -= factor * far[i]
        y[i + 1] -= factor * y[i]
    d[-1] = d[-1] if abs(d[-1]) > tiny else tiny
    for i in range(n - 1, -1, -1):
        y[i] -= up[i] * y[i + 1] if i + 1 < n else 0.0
        y[i] -= far[i] * y[i + 2] if i + 2 < n else 0.0
        y[i] /= d[i]
    return np.array(y)


def leading_vectors(diagonal: np.ndarray, beside: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A unit vector for each value, by inverse iteration; those of close values are made orthogonal in every step."""
    norm = float(np.max(np.abs(diagonal)) + 2 * np.max(np.abs(beside), initial=0.0)) or 1.0
    tiny, start, out = norm * np.finfo(float).eps, np.random.default_rng(0), []
    for j, value in enumerate(values):
        close = [out[i] for i in range(j) if values[i] - value <= CLUSTER * norm]
        y = start.normal(size=len(diagonal))
        for _ in range(6):
            y = _solved(diagonal, beside, value, y / np.linalg.norm(y), tiny)
            y /= np.max(np.abs(y))
            for _ in range(2):
                for other in close:
                    y -= (other @ y) * other
        out.append(y / np.linalg.norm(y))
    return np.array(out)


def leading_components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest eigenvalues of a symmetric matrix, falling, and their unit vectors as rows.

    A vector's entry of greatest size is positive.
    """
    size = float(np.max(np.abs(matrix), initial=0.0))
    if not size:
        return np.zeros(0), np.zeros((0, len(matrix)))
    diagonal, beside, mirrors = tridiagonal(matrix / size)
    values = leading_values(diagonal, beside, min(k, len(matrix)))
    found = []
    for y in leading_vectors(diagonal, beside, values):
        v = reflected(y, mirrors)
        for _ in range(2):
            for other in found:
                v -= (other @ v) * other
        v /= np.linalg.norm(v)
        found.append(v * np.sign(v[np.argmax(np.abs(v))]))
    vectors = np.array(found)
    values = np.array([v @ matrix @ v for v in vectors])
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[order]


def fit(coded: DataFrame, length: int, k: int = COMPONENTS) -> tuple[Fit, DataFrame]:
    """The model of the distinct vectors, and these vectors as a written table."""
    if length > MAX_LENGTH:
        raise ConfigError(f"vectors of {length} entries: at most {MAX_LENGTH} are fitted")
    distinct = materialize(coded.where(F.size("x") == length).select("x").distinct(), "whitening-fit")
    n, sums = totals(distinct, length) if length else (0, ())
    matrix = covariance(distinct, length, n, sums) if n else np.zeros((0, 0))
    values, vectors = leading_components(matrix, k)
    keep = values > (LEAST_PART * values[0] if len(values) else 0)
    return Fit(n, sums, float(np.trace(matrix)), values[keep], vectors[keep]), distinct


def _whitened(y: np.ndarray, model: Fit) -> np.ndarray:
    """Rows of n * x - sums on the components, in units of their standard deviations."""
    return (y / model.n).astype(np.float64) @ model.vectors.T / np.sqrt(model.values)


def identity_error(distinct: DataFrame, length: int, model: Fit) -> float:
    """How far the covariance of the whitened fit list is from the identity, in its worst entry."""
    k = len(model.values)
    shared = distinct.sparkSession.sparkContext.broadcast(model)
    names = [f"z{i}" for i in range(k)]

    def task(batches):
        for _, x in _blocks(batches, 0, length):
            z = _whitened(centred(x, shared.value.n, shared.value.sums), shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in z.T.copy()], names=names)

    z = distinct.mapInArrow(task, ", ".join(f"{c} double" for c in names))
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    row = z.agg(*[F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in cells]).first()
    return max(abs(row[f"c{i}_{j}"] - (i == j)) for i, j in cells)


def project(coded: DataFrame, length: int, model: Fit, error: float) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row of this length."""
    schema = pa.schema([
        ("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
        ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64()),
    ])
    shared = coded.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        m = shared.value
        k, explained = len(m.values), m.values / m.trace
        for part, x in _blocks(batches, 1, length):
            y = centred(x, m.n, m.sums)
            exact = _exact(y, length * _most(y) ** 2)
            off = [v if v < 1 << 63 else None for v in (exact * exact).sum(axis=1).tolist()]
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(pa.array(np.repeat(np.arange(len(x)), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(x) * k, m.n)),
                pa.array([v for v in off for _ in range(k)], pa.int64()),
                pa.array(_whitened(y, m).ravel()),
                pa.array(np.tile(explained, len(x))),
                pa.array(np.full(len(x) * k, error)),
            ], schema=schema)

    used = coded.where(F.size("x") == length) if len(model.values) else coded.where("false")
    return used.mapInArrow(
        task, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """Every usable row on the k leading components of the distinct vectors, one row for each component."""
    coded = codes(table, id_col, vector_col)
    length = commonest_length(coded)
    model, distinct = fit(coded, length, k)
    error = identity_error(distinct, length, model) if len(model.values) else 0.0
    return project(coded, length, model, error)
