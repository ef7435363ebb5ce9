"""Whitening of vectors by the eigenvectors of their covariance.

Vectors are rounded to integers, so that equal ones are found exactly; the fit counts each distinct vector once. Sums are exact, the
covariance is summed per partition from centred vectors and added up by rows of the matrix. The eigenvectors come from this dims x dims matrix
on the driver: Householder reflections make it tridiagonal, Sturm counts bisect its leading eigenvalues, inverse iteration finds
their vectors, orthogonal to those of close eigenvalues. The matrix of components (dims x components) is broadcast for the projection.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import kept

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Largest number of dimensions: the matrix on the driver is then at most 134 MB, components are bounded by it as well.
MOST_DIMS = 4096
#: Eigenvalues under this share of the largest are rounding errors; such directions can't be whitened.
NEGLIGIBLE = 1e-12


# --- eigenvectors of a symmetric matrix --------------------------------------------------

def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, subdiagonal and Householder vectors of the tridiagonal form of a symmetric matrix."""
    a, d = matrix.copy(), len(matrix)
    mirrors: list[np.ndarray] = []
    for k in range(d - 2):
        x = a[k + 1:, k].copy()
        norm = np.linalg.norm(x)
        if norm > 0 and np.any(x[1:]):
            x[0] += np.copysign(norm, x[0])
            x /= np.linalg.norm(x)
            rest = a[k + 1:, k + 1:]
            p = 2 * (rest @ x)
            q = p - (x @ p) * x
            rest -= np.outer(x, q) + np.outer(q, x)
            a[k + 1, k] = -np.copysign(norm, a[k + 1, k])
            mirrors.append(x)
        else:
            mirrors.append(np.zeros(len(x)))
    return np.diag(a).copy(), np.array([a[k + 1, k] for k in range(d - 1)]), mirrors


def counts_below(diagonal: np.ndarray, squares: np.ndarray, values: np.ndarray, tiny: float) -> np.ndarray:
    """Sturm counts: number of eigenvalues below each of ``values``."""
    q = diagonal[0] - values
    count = (q < 0).astype(int)
    for a, b in zip(diagonal[1:], squares):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        q = a - values - b / q
        count += q < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, below: np.ndarray, number: int) -> np.ndarray:
    """The ``number`` largest eigenvalues, falling, each bisected until its bounds are neighbours in doubles."""
    d = len(diagonal)
    reach = np.concatenate([np.abs(below), [0]]) + np.concatenate([[0], np.abs(below)])
    tiny = np.finfo(float).tiny * max(1.0, float(np.max(below ** 2, initial=0.0))) / np.finfo(float).eps
    low, high = np.full(number, np.min(diagonal - reach)), np.full(number, np.max(diagonal + reach))
    high += np.finfo(float).eps * np.maximum(np.abs(low), np.abs(high)) * 4
    wanted = d - np.arange(number)  # so many eigenvalues are below a bound that is above this one
    while True:
        middle = low + (high - low) / 2
        if np.all((middle <= low) | (middle >= high)):
            return middle
        above = counts_below(diagonal, below ** 2, middle, tiny) >= wanted
        inner = (middle > low) & (middle < high)
        high = np.where(above & inner, middle, high)
        low = np.where(~above & inner, middle, low)


def solver(diagonal: np.ndarray, below: np.ndarray, value: float, least: float) -> Callable[[np.ndarray], np.ndarray]:
    """Solve (T - value) x = b by elimination with row exchanges."""
    d = len(diagonal)
    main, upper, second = (diagonal - value).tolist(), [*below.tolist(), 0.0], [0.0] * d
    factors, exchanged = [0.0] * d, [False] * d
    for i in range(d - 1):
        under = float(below[i])
        if abs(under) > abs(main[i]):
            exchanged[i] = True
            main[i], under, upper[i], main[i + 1] = under, main[i], main[i + 1], upper[i]
            second[i], upper[i + 1] = upper[i + 1], 0.0
        pivot = main[i] if abs(main[i]) > least else (least if main[i] >= 0 else -least)
        main[i] = pivot
        factors[i] = under / pivot
        main[i + 1] -= factors[i] * upper[i]
        upper[i + 1] -= factors[i] * second[i]
    if abs(main[-1]) <= least:
        main[-1] = least

    def solve(b: np.ndarray) -> np.ndarray:
        x = b.tolist()
        for i in range(d - 1):
            if exchanged[i]:
                x[i], x[i + 1] = x[i + 1], x[i]
            x[i + 1] -= factors[i] * x[i]
        for i in range(d - 1, -1, -1):
            rest = x[i]
            if i + 1 < d:
                rest -= upper[i] * x[i + 1]
            if i + 2 < d:
                rest -= second[i] * x[i + 2]
            x[i] = rest / main[i]
        return np.array(x)

    return solve


def eigenvectors(diagonal: np.ndarray, below: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) by inverse iteration; vectors of a cluster of close values are kept orthogonal."""
    d = len(diagonal)
    scale = max(float(np.max(np.abs(diagonal))), float(np.max(np.abs(below), initial=0.0)), np.finfo(float).tiny)
    least, close = np.finfo(float).eps * scale, 1e-3 * scale
    random, out, begin, used = np.random.default_rng(11), np.zeros((d, len(values))), 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > close:
            begin = k
        # Equal values get slightly different shifts, so that their solutions differ.
        shift = min(value, used - 2 * least) if k > begin else value
        used = shift
        solve, x = solver(diagonal, below, shift, least), random.standard_normal(d)
        cluster = out[:, begin:k]
        for _ in range(6):
            for _ in range(2):
                x = x - cluster @ (cluster.T @ x)
            x = solve(x / np.linalg.norm(x))
        for _ in range(2):
            x = x - cluster @ (cluster.T @ x)
        out[:, k] = x / np.linalg.norm(x)
    return out


def leading_components(matrix: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of the largest eigenvalues of a symmetric matrix that are not negligible."""
    number = min(number, len(matrix))
    diagonal, below, mirrors = tridiagonal(matrix)
    values = leading_eigenvalues(diagonal, below, number)
    values = values[values > NEGLIGIBLE * max(values[0], 0.0)] if values[0] > 0 else values[:0]
    vectors = eigenvectors(diagonal, below, values)
    for k in range(len(mirrors) - 1, -1, -1):
        x = mirrors[k]
        vectors[k + 1:] -= 2 * np.outer(x, x @ vectors[k + 1:])
    return values, vectors


# --- sums over the vectors ------------------------------------------------------------------

def _rows(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def second_moments(vectors: DataFrame, name: str, size: int, prepare: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of v v' over ``prepare`` of all vectors, as a size x size matrix.

    A partition sends on one matrix, by rows; the rows of one number are added in one task, and ``size`` rows come to the driver.
    """

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            for start in range(0, len(batch), 2048):
                rows = prepare(_rows(batch.slice(start, 2048), name))
                total += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "v"])

    def added(table: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in table:
            rows = _rows(batch, "v").sum(axis=0)
            total, i = rows if total is None else total + rows, batch.column("i")[0].as_py()
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total], pa.list_(pa.float64()))], names=["i", "v"])

    schema = "i int, v array<double>"
    by_row = vectors.select(name).mapInArrow(partial, schema).groupBy("i").applyInArrow(lambda t: pa.Table.from_batches(added(iter(t.to_batches()))), schema)
    out = np.zeros((size, size))
    for row in by_row.collect():
        out[row["i"]] = row["v"]
    return out


def rounded(vectors: DataFrame, id_: str, vector: str) -> DataFrame:
    """(id, x): the usable vectors as integers; the others are left out."""
    entries = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)
    sound = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).where(sound).select(F.col(id_).alias("id"), entries.alias("x"))


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per usable row and component: id, component (from 1), n, deviation, whitened, explained, identity_error.

    Vectors that are null or empty or hold a null or non-finite entry are left out, as are those of another length than most have
    (of equally many the longest). Entries become floor(64 * c) + 1000000. The fit takes each distinct vector once: ``n`` vectors with
    sums S; deviation is the sum of (n * x - S)^2, in exact integers (beyond a 64-bit number it raises); whitened the
    centred vector's projection on the unit eigenvector over the root of its eigenvalue; explained that eigenvalue's share of the trace;
    identity_error the largest entry of the measured covariance of whitened, over the fit's vectors, less the identity. Components whose
    eigenvalue is zero but for rounding are left out, so one distinct vector gives no rows. Repeated rows and null ids stay as they are.
    Other columns are ignored. More than 4096 dimensions raise.
    """
    usable = rounded(vectors, id_, vector)
    fit = kept(usable.select("x").distinct(), "whitening-fit")
    kind = vectors.schema[id_].dataType.simpleString()
    schema = f"{id_} {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    lengths = usable.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("rows")).agg(F.max(F.struct("rows", "d")).alias("most")).first()["most"]
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dims = lengths["d"]
    if dims > MOST_DIMS:
        raise ValueError(f"vectors of {dims} dimensions; at most {MOST_DIMS} are supported")
    usable, fit = usable.where(F.size("x") == dims), fit.where(F.size("x") == dims)
    # Exact sums per dimension, combined in each task.
    sums = fit.select(F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(F.sum("v").alias("s"), F.count("*").alias("n")).collect()
    n, totals = sums[0]["n"], [r["s"] for r in sorted(sums, key=lambda r: r["pos"])]
    whole_part = np.array([s // n for s in totals])
    fraction = np.array([(s % n) / n for s in totals])  # the mean without its whole part keeps all digits of the difference

    def centred(rows: np.ndarray) -> np.ndarray:
        return (rows - whole_part) - fraction

    covariance = second_moments(fit, "x", dims, centred) / n
    values, basis = leading_components(covariance, components)
    if not len(values):
        return vectors.sparkSession.createDataFrame([], schema)
    size = len(values)
    sent = vectors.sparkSession.sparkContext.broadcast(basis / np.sqrt(values))
    measured = second_moments(fit, "x", size, lambda rows: centred(rows) @ sent.value) / n
    identity_error = float(np.max(np.abs(measured - np.eye(size))))
    explained = values / np.trace(covariance)

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 2048):
                part = batch.slice(start, 2048)
                rows = centred(_rows(part, "x")) @ sent.value
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("deviation"), pa.array(list(rows), pa.list_(pa.float64()))], names=["id", "deviation", "w"])

    difference = F.zip_with("x", F.array(*[F.lit(s) for s in totals]), lambda x, s: x * F.lit(n) - s)
    deviation = F.aggregate(difference, F.lit(0).cast("long"), lambda acc, v: acc + v * v)
    made = usable.select("id", "x", deviation.alias("deviation")).mapInArrow(project, f"id {kind}, deviation bigint, w array<double>")
    each = made.select("id", "deviation", F.posexplode("w").alias("pos", "whitened"))
    shares = F.array(*[F.lit(float(v)) for v in explained])
    return each.select(
        F.col("id").alias(id_), (F.col("pos") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("pos") + 1).alias("explained"), F.lit(identity_error).alias("identity_error"),
    )
