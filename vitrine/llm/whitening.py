"""PCA whitening by Chebyshev-filtered subspace iteration.

The covariance V of the fit list is never formed. A pass over the list, one partial sum a task, gives V times a narrow block of
vectors: the sum of xc (xc' Q) over its centred rows xc. Between two Rayleigh-Ritz steps DEGREE passes run the three-term
recurrence of the Chebyshev polynomial that is small on [0, cut], cut being the block's lowest Ritz value, so that the
spectrum below is damped while the leading directions grow. QR makes the block orthonormal again, Rayleigh-Ritz turns it to the
eigenvectors, and the residuals |V q - e q| tell when they are certified.

What a pass brings to the driver is the size of the block, whatever the number of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.session import write_table

BLOCK, DEGREE = 32, 12
TOLERANCE = 1e-14   # of the largest eigenvalue: residuals to aim at,
CERTIFIED = 1e-11   # and the largest to accept where rounding stops them
ROUNDS = 200
NOTHING = 1e-12     # eigenvalues below this share of the largest are zero
CHUNK = 1 << 20     # components at work at a time
_LONG = 1 << 63


def integer_vectors(rows: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x): floor(scale * c) of the rows whose components are all there and finite."""
    v = F.col(vector_col)
    whole = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return rows.where(v.isNotNull() & whole).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("x"))


def _matrices(column: pa.Array, dim: int) -> Iterator[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)
    step = max(1, CHUNK // dim)
    return (flat[a: a + step] for a in range(0, len(flat), step))


def total(fit: DataFrame, dim: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of ``part(x)`` over all rows of ``fit`` (x), taken in chunks: summed within each task, then by position."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for b in batches:
            for x in _matrices(b.column(0), dim):
                got = part(x)
                own = got if own is None else own + got
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(own))), pa.array(own)], ["at", "value"])

    sums = fit.select("x").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas()
    return sums.sort_values("at")["value"].to_numpy()


def column_sums(fit: DataFrame, dim: int) -> list[int]:
    """Exact sums of each dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [0] * dim
        for b in batches:
            for x in _matrices(b.column(0), dim):
                small = float(np.abs(x.astype(np.float64)).max(initial=0)) * len(x) < 2.0 ** 62
                own = [a + int(s) for a, s in zip(own, (x if small else x.astype(object)).sum(0))]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array([str(s) for s in own])], ["at", "value"])

    sums = fit.select("x").mapInArrow(run, "at long, value string").groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    return [int(r["value"]) for r in sums.orderBy("at").collect()]


def leading(times: Callable[[np.ndarray], np.ndarray], dim: int, k: int, block: int = BLOCK, degree: int = DEGREE,
            seed: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of the symmetric positive semidefinite V, unit eigenvectors and residuals over the largest
    eigenvalue; ``times(Q)`` is V Q. Ends when the residuals are at TOLERANCE, or stand still below CERTIFIED; raises otherwise."""
    width = min(dim, max(block, 2 * k))
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, width)))[0]
    before = np.inf
    for _ in range(ROUNDS):
        vq = times(q)
        small = q.T @ vq
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        top = max(values[0], 0.0)
        if top == 0:
            return values[:0], q[:, :0], values[:0]
        residual = np.sqrt(((vq - q * values) ** 2).sum(0))[:k] / top
        worst = residual.max()
        if worst <= TOLERANCE or worst <= CERTIFIED and worst > 0.5 * before or width == dim:
            break
        before = worst
        q = filtered(times, q, vq, max(values[-1], 0.0), top, degree)
    else:
        raise ArithmeticError(f"residuals of {worst:.1e} after {ROUNDS} rounds")
    there = values[:k] > NOTHING * top
    return values[:k][there], q[:, :k][:, there], residual[there]


def filtered(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, vq: np.ndarray, cut: float, top: float, degree: int) -> np.ndarray:
    """Orthonormal block of p(V) q: p is the Chebyshev polynomial of [0, cut], scaled to stay near 1 at ``top``; ``vq`` is V q."""
    half = max(cut, 1e-12 * top) / 2
    sigma = half / (top - half)
    first = 2 / sigma
    old, new = q, (vq - half * q) * (sigma / half)
    for _ in range(1, degree):
        after = 1 / (first - sigma)
        old, new = new, (times(new) - half * new) * (2 * after / half) - (sigma * after) * old
        sigma = after
    return np.linalg.qr(new)[0]


@dataclass(frozen=True)
class Whitening:
    n: int                   # rows of the fit list
    sums: list[int]
    values: np.ndarray       # eigenvalues, falling
    vectors: np.ndarray      # unit eigenvectors, as columns
    residuals: np.ndarray
    trace: float
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])


def fit_whitening(rows: DataFrame, components: int = 4, block: int = BLOCK, degree: int = DEGREE) -> Whitening | None:
    """Fit on each distinct ``x`` of ``rows`` (vec_id, x) once. None if there is none; no component if all are equal.

    Vectors of different lengths can't share a covariance: the most frequent length is fitted, of equally frequent ones the
    smallest. Eigenvalues of zero are no components."""
    fit = write_table(rows.select("x").where(F.size("x") > 0).distinct().withColumn("dim", F.size("x")), "fit")
    most = fit.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if most is None:
        return None
    dim, n = most["dim"], most["count"]
    fit = fit.where(F.col("dim") == dim)
    sums = column_sums(fit, dim)
    mean = np.array([float(Fraction(s, n)) for s in sums])
    trace = float(total(fit, dim, lambda x: np.array([((x - mean) ** 2).sum()]))[0]) / n

    def times(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return (centred.T @ (centred @ q)).ravel()
        return total(fit, dim, part).reshape(q.shape) / n

    values, vectors, residuals = leading(times, dim, min(components, dim), block, degree)
    error = 0.0
    if len(values):
        turn = vectors / np.sqrt(values)
        middle = total(fit, dim, lambda x: ((x - mean) @ turn).sum(0)) / n

        def spread(x: np.ndarray) -> np.ndarray:
            w = (x - mean) @ turn - middle
            return (w.T @ w).ravel()
        error = float(np.abs(total(fit, dim, spread).reshape(len(values), -1) / n - np.eye(len(values))).max())
    return Whitening(n, sums, values, vectors, residuals, trace, error)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n x - sums) ** 2 of each row, exact; None beyond 64 bits."""
    reach = n * int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))) + max(map(abs, sums), default=0)
    if reach * reach * max(1, x.shape[1]) < _LONG:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(1)
    return [int(v) if v < _LONG else None for v in exact]


def whiten(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each of ``rows`` (vec_id, x) and each
    component. Rows of another length than the fitted one take no part; repeated ones and those with a NULL id each count.
    ``deviation`` is NULL where it has more than 64 bits. Without a model or a component there is no row."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema)
    dim, k, mean, turn = len(model.sums), len(model.values), model.mean, model.vectors / np.sqrt(model.values)
    explained = model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for x in _matrices(b.column(1), dim):
                ids = b.column(0).slice(at, len(x)).take(pa.array(np.repeat(np.arange(len(x)), k)))
                at += len(x)
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, model.n)),
                    pa.array([d for d in deviations(x, model.n, model.sums) for _ in range(k)], pa.int64()),
                    pa.array(((x - mean) @ turn).ravel()), pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(x) * k, model.identity_error))], [f.split()[0] for f in schema.split(", ")])

    return rows.where(F.size("x") == dim).select("vec_id", "x").mapInArrow(run, schema)


def whiten_vectors(rows: DataFrame, components: int = 4, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Fit on and whiten the vectors floor(scale * c) of ``rows``. A NULL vector, or one with a NULL or non-finite component, takes
    no part, nor does an empty one. Extra columns are left out; an empty table gives an empty table."""
    own = integer_vectors(rows, scale, id_col, vector_col)
    return whiten(own, fit_whitening(own, components))
