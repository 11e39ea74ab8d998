"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Let Y be the matrix of centred rows. Starting from a random unit vector v, the steps alternate between ``u ~ Y v - beta u'`` and
``v' ~ Yᵀ u - alpha v``; every new u and v is orthogonalised against all earlier ones. ``Y V = U B`` with a small bidiagonal B, whose
singular values and vectors give the components and their deviations. Where a step ends in zero (some directions have no variance, or
several have the same) it goes on with a new random vector that is orthogonal to all others, so that V becomes a whole basis.

The long vectors u are never stored: each is a combination ``Y w``, and the driver keeps the short w. A step is one pass over the rows
that returns ``YᵀY z``, ``Uᵀ Y z`` and ``|Y z|²``, summed in the tasks and then in as many tasks as the square root of their number.
So a step's state is a few short vectors, and a lost executor costs its part of one pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import materialise

# Entries as longs: floor(SCALE * c) + SHIFT. Larger entries than LARGEST have no exact long and count as not finite.
SCALE, SHIFT, LARGEST = 64, 1_000_000, float(1 << 46)
# Share of the largest deviation below which a direction counts as one without variance.
NEGLIGIBLE = 1e-11


def integer_vectors(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id, x``: the vectors without null or non-finite entries as longs.

    Vectors of other lengths than most have (the longest of equally many) take no part, and neither do empty ones.
    """
    c = F.col(vector)
    usable = F.coalesce(F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < LARGEST)), F.lit(False)) & (F.size(c) > 0)
    rows = vectors.where(usable).select(
        F.col("vec_id"), F.transform(c, lambda v: F.floor(v.cast("double") * SCALE) + F.lit(SHIFT).cast("long")).alias("x"))
    most = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("x") == (most[0].d if most else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def summed(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], size: int, kind: str = "double") -> np.ndarray:
    """The sum of ``of(matrix of x)``, ``size`` numbers, over all batches of ``rows``: in each task, then in a root of as many."""
    exact = np.int64 if kind == "long" else np.float64

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, exact)
        for batch in batches:
            if len(batch):
                total += of(_matrix(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.from_numpy_dtype(exact)))], ["total"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, exact)
        for batch in batches:
            if len(batch):
                total += _matrix(batch.column(0)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.from_numpy_dtype(exact)))], ["total"])

    schema = f"total array<{kind}>"
    few = max(1, math.isqrt(rows.rdd.getNumPartitions()))
    parts = rows.select("x").mapInArrow(part, schema).repartition(few).mapInArrow(add, schema).toArrow()["total"].combine_chunks()
    return _matrix(parts).sum(0) if len(parts) else np.zeros(size, exact)


class Centred:
    """Centred rows of a fit list: ``n`` rows with sums ``s`` per dimension. Differences ``n * x - s`` are exact."""

    def __init__(self, n: int, s: np.ndarray):
        self.n, self.s = n, s

    def exact(self, x: np.ndarray) -> np.ndarray:
        return self.n * x - self.s

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.exact(x) / self.n


def _orthogonal(r: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for v in basis:
            r = r - (v @ r) * v
    return r


def bidiagonalise(step: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, float]], d: int, size: float, steps: int | None = None,
                  seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """V (columns) and B with ``Y V = U B``, after ``steps`` steps (all ``d`` of them by default, which makes V a basis).

    ``step(z, W)`` returns ``YᵀY z``, ``Wᵀ YᵀY z`` and ``|Y z|²``; ``size`` is the norm of Y.
    """
    rng = np.random.default_rng(seed)
    none = NEGLIGIBLE * size

    def fresh() -> np.ndarray:
        r = _orthogonal(rng.standard_normal(d), vs)
        return r / np.linalg.norm(r)

    vs: list[np.ndarray] = []
    ws = np.zeros((d, 0))
    b = np.zeros((d, d))
    back = np.zeros((d, 0))  # Yᵀ u of every u
    v, beta = fresh(), 0.0
    while True:
        vs.append(v)
        j = len(vs) - 1
        z = v - beta * ws[:, -1] if beta else v
        if beta:
            b[ws.shape[1] - 1, j] = beta
        yy, along, square = step(z, ws)
        alpha = math.sqrt(max(0.0, square - along @ along))
        beta = 0.0
        if alpha > none:
            w = (z - ws @ along) / alpha
            u_back = (yy - back @ along) / alpha
            ws, back = np.column_stack([ws, w]), np.column_stack([back, u_back])
            b[ws.shape[1] - 1, j] = alpha
            r = _orthogonal(u_back - alpha * v, vs)
            beta = float(np.linalg.norm(r))
        if len(vs) == min(d, steps or d):
            break
        if beta > none:
            v = r / beta
        else:
            v, beta = fresh(), 0.0
    return np.column_stack(vs), b[: max(1, ws.shape[1]), : len(vs)]


def principal_components(fit: DataFrame, n: int, d: int, keep: int = 16, steps: int | None = None) -> tuple[Centred, np.ndarray, np.ndarray, float]:
    """Of a table of distinct vectors ``x``: its centring, components (columns, at most ``keep``), their variances, and the trace.

    Directions without variance aren't components.
    """
    sums = summed(fit, lambda x: x.sum(0), d, "long")
    centred = Centred(n, sums)
    trace = float(summed(fit, lambda x: np.array([np.square(centred(x)).sum()]), 1)[0]) / n if n else 0.0
    if trace == 0:
        return centred, np.zeros((d, 0)), np.zeros(0), 0.0

    def step(z: np.ndarray, ws: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        context = fit.sparkSession.sparkContext
        shared = context.broadcast((centred.n, centred.s, z, ws))  # as many numbers as two bases have

        def products(x: np.ndarray) -> np.ndarray:
            count, s, z, ws = shared.value
            y = (count * x - s) / count
            p = y @ z
            return np.concatenate([y.T @ p, (y @ ws).T @ p, [p @ p]])

        out = summed(fit, products, d + ws.shape[1] + 1)
        shared.unpersist()
        return out[:d], out[d:-1], float(out[-1])

    size = math.sqrt(trace * n)
    basis, b = bidiagonalise(step, d, size, steps)
    _, sigma, right = np.linalg.svd(b)
    kept = int((sigma[:keep] > NEGLIGIBLE * size).sum())
    components = basis @ right[:kept].T
    return centred, components / np.linalg.norm(components, axis=0), np.square(sigma[:kept]) / n, trace


def whiten(vectors: DataFrame, keep: int = 16, vector: str = "embedding", steps: int | None = None) -> DataFrame:
    """Per vector and component: ``vec_id, component (from 1), n, deviation, whitened, explained, identity_error``.

    Vectors that are null or empty, hold null or non-finite entries, or have another length than most take no part. Each remaining entry c is
    the long ``floor(64 * c) + 1000000``; components are those of the distinct vectors' covariance. Equal vectors and repeated ids give rows each, null
    ids stay null, other columns are ignored. Without vectors, or where all are equal, there are no components and no rows. ``deviation`` is
    null where it doesn't fit a long. ``steps`` below the dimension end the bidiagonalisation early.
    """
    rows = materialise(integer_vectors(vectors, vector).withColumn("vec_id", F.col("vec_id").cast("long")))
    fit = materialise(rows.select("x").distinct())
    first = fit.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()
    n, d = first.n, first.d or 1
    centred, components, variances, trace = principal_components(fit, n, d, keep, steps)
    k = len(variances)
    shared = vectors.sparkSession.sparkContext.broadcast((n, centred.s, components / np.sqrt(variances)))

    def second_moments(x: np.ndarray) -> np.ndarray:
        count, s, scaled = shared.value
        w = ((count * x - s) / count) @ scaled
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    moments = summed(fit, second_moments, k + k * k) if k else np.zeros(0)
    mean = moments[:k] / max(1, n)
    error = float(np.abs(moments[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max()) if k else 0.0
    explained = variances / trace if k else variances

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, s, scaled = shared.value
        for batch in batches:
            if not len(batch) or not k:
                continue
            exact = count * _matrix(batch.column(1)) - s
            fits = np.square(exact.astype(float)).sum(1) < 9.2e18
            deviation = np.where(fits, np.square(exact).sum(1), 0)
            m = len(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                 pa.array(np.full(m * k, count, np.int64)), pa.array(np.repeat(deviation, k), mask=np.repeat(~fits, k)),
                 pa.array(((exact / count) @ scaled).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
