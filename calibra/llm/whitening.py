"""Whitening of embeddings along their main components.

A randomised range finder multiplies a few more random directions than are wanted by the covariance of all centred rows,
pass after pass, and Rayleigh-Ritz takes the components from the range that this leaves. Where the residuals say that a
component is not yet exact and more passes would not make it so, the range becomes the whole space, and one pass gives
the covariance itself. Only matrices of the vectors' dimension, never rows, reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.llm.common import forget, saved, table
from calibra.llm.vectors import matrix, scaled_rows

COMPONENTS, OVERSAMPLING, MOST_PASSES, SEED = 16, 8, 8, 12
#: A component is exact if its residual is at most this share of its distance to the next eigenvalues.
EXACT = 1e-12
#: Components whose variance is a smaller share of all are rounding, and no directions.
LEAST_SHARE = 1e-12
SCALE, OFFSET = 64, 1_000_000

Batches = Iterator[pa.RecordBatch]


@dataclass
class Whitener:
    """What whitening needs: n fitted vectors, their sums, unit components as columns, variances, the trace."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    trace: float

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly."""
        if self.n * float(np.abs(x).max(initial=0)) + float(np.abs(self.sums).max(initial=0)) >= 2.0**62:
            raise OverflowError("n times a component does not fit in 64 bits")
        return self.n * x - self.sums

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x) / self.n @ self.components / np.sqrt(self.variances)


def _sums(batches: Batches) -> Batches:
    n, total = 0, None
    for batch in batches:
        if batch.num_rows:
            n, own = n + batch.num_rows, matrix(batch).sum(axis=0)
            total = own if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total)), pa.int32()), pa.array([n, *total.tolist()], pa.int64())], ["i", "v"])


def column_sums(rows: DataFrame) -> tuple[int, np.ndarray]:
    """The number of rows and their exact sum."""
    got = dict(rows.mapInArrow(_sums, "i int, v long").groupBy("i").agg(F.sum("v")).collect())
    return got.pop(-1, 0), np.array([got[i] for i in sorted(got)], np.int64)


def _products(of: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Callable[[Batches], Batches]:
    """Row i of the sum of a^T b over a task's batches, where of gives a and b."""

    def run(batches: Batches) -> Batches:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                a, b = of(matrix(batch.slice(at, 4096)))
                total = a.T @ b if total is None else total + a.T @ b
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "v"])

    return run


def summed_products(rows: DataFrame, of: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], width: int) -> np.ndarray:
    """The sum of a^T b over all rows; tasks send their own sums, which meet by matrix row."""
    found = rows.mapInArrow(_products(of), "i int, v array<double>").groupBy("i").agg(F.array(*[F.sum(F.col("v")[j]) for j in range(width)]).alias("v"))
    return np.array([r["v"] for r in sorted(found.collect())], float).reshape(-1, width)


def main_components(fit: DataFrame, n: int, sums: np.ndarray, wanted: int) -> Whitener:
    """The components of the fit rows' covariance with the largest variances, by falling variance."""
    d = len(sums)
    w = Whitener(n, sums, np.eye(d), np.ones(d), 0.0)

    def times_covariance(q: np.ndarray) -> np.ndarray:
        def of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            centred = w.deviations(x) / n
            return centred, centred @ q

        return summed_products(fit, of, q.shape[1]) / n

    def squares(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        centred = w.deviations(x) / n
        return np.ones((len(x), 1)), centred * centred

    w.trace = float(summed_products(fit, squares, d).sum() / n)
    wanted, width = min(wanted, d), min(d, wanted + OVERSAMPLING)
    q = np.linalg.qr(np.random.default_rng(SEED).normal(size=(d, width)))[0] if width < d else np.eye(d)
    before = np.inf
    for left in range(MOST_PASSES - 1, -1, -1):
        product = times_covariance(q)
        values, vectors, off = rayleigh_ritz(q, product, wanted)
        if width == d or off <= EXACT:
            break
        # Each pass shrinks what is off by about the same factor; if that will not do, the range is the whole space.
        if left == 0 or (before < np.inf and off * (off / before) ** left > EXACT):
            width, q = d, np.eye(d)
            values, vectors, off = rayleigh_ritz(q, times_covariance(q), wanted)
            break
        before, q = off, np.linalg.qr(product)[0]
    real = values > LEAST_SHARE * w.trace
    w.components, w.variances = vectors[:, real], values[real]
    return w


def rayleigh_ritz(q: np.ndarray, product: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Values and vectors within the range of q, and the greatest residual as a share of the distance to the next values.

    What rounding of the largest value leaves, which the whole space has too, is taken off residuals.
    """
    small = q.T @ product
    values, inner = np.linalg.eigh((small + small.T) / 2)
    values, inner = values[::-1], inner[:, ::-1]
    vectors = q @ inner
    residual = np.linalg.norm(product @ inner - vectors * values, axis=0)[:wanted]
    residual = np.maximum(residual - 32 * np.finfo(float).eps * np.abs(values).max(initial=0), 0)
    gaps = np.abs(np.diff(values))
    near = np.minimum(np.append(gaps, np.inf), np.insert(gaps, 0, np.inf))[:wanted]
    off = float((residual / np.maximum(near, 1e-300)).max(initial=0))
    return np.maximum(values[:wanted], 0), vectors[:, :wanted], off


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double"


def _whiten(w: Whitener) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        k = len(w.variances)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = matrix(part)
                off, m = w.deviations(x), part.num_rows
                if float(np.abs(off).max(initial=0)) ** 2 * x.shape[1] < 2.0**62:
                    deviation = pa.array((off * off).sum(axis=1), pa.int64())
                else:  # beyond 64 bits this is an error
                    deviation = pa.array([sum(int(v) ** 2 for v in row) for row in off], pa.int64())
                rows = pa.array(np.repeat(np.arange(m), k))
                columns = [part.column("vec_id").take(rows), np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, w.n), deviation.take(rows), w.whiten(x).ravel(), np.tile(w.variances / w.trace if w.trace else w.variances, m)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [f.split()[0] for f in WHITENED.split(", ")])

    return run


def whiten(rows: DataFrame, wanted: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """Each row's whitened coordinates along the main components of all different vectors.

    A vector's entries become floor(64 * c) + 1,000,000. scaled_rows says which rows take part. Equal vectors are fitted
    once; rows that repeat a vec_id or a vector each have their own result, a null vec_id too. Directions without variance
    are no components, so equal vectors alone, and an empty table, give no rows. Of equal variances any basis may come.
    Other columns are ignored. n * x and deviations beyond 64 bits are an error.
    """
    scaled = scaled_rows(rows, vector, SCALE, OFFSET, ["vec_id"]).withColumn("vec_id", F.col("vec_id").cast("long"))
    fit = saved(scaled.select("x").distinct(), "whiten-fit")
    n, sums = column_sums(fit)
    if n and len(sums):
        w = main_components(fit, n, sums, wanted)
    else:
        w = Whitener(0, sums, np.zeros((0, 0)), np.zeros(0), 0.0)
    k = len(w.variances)
    error = np.abs(summed_products(fit, lambda x: (w.whiten(x),) * 2, k) / n - np.eye(k)).max() if k else 0.0
    forget(fit)
    if not k:
        return scaled.sparkSession.createDataFrame([], WHITENED + ", identity_error double")
    return scaled.mapInArrow(_whiten(w), WHITENED).withColumn("identity_error", F.lit(float(error)))


def op12_range_finder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
