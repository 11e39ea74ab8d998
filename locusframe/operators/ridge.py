"""Ridge regression / BLUP of marker effects on z-scored markers and y.

Three ways to the same effects ``(Z'Z + delta I)^-1 Z'y``: the p x p system, the n x n system with
``beta = Z'a``, and conjugate gradients on the tile table. The first brings its small side to the driver (size checked), the second does so where n is
small and else takes conjugate gradients for ``a``; gradients keep matrix and vectors distributed and have no size limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.functions.ranking import index_by_integer
from locusframe.functions.scalar import observed
from locusframe.operators import cholesky
from locusframe.operators.regression import dense_triangle, multi_reg, numbered_gram
from locusframe.operators.tiles import COLS, ROWS, block_counts, decode, gram, tile_table, with_stats
from locusframe.operators.transform import scale_params
from locusframe.session import MAX_DRIVER_SIDE, collect_bounded, discard, materialise

VECTOR_BYTES = 256 << 20


def people(geno: DataFrame, pheno: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Genotypes and phenotypes of those who have both: every sum of a fit runs over them."""
    known = pheno.where("y is not null").select("iid", "y")
    cells = geno.join(known.select("iid"), "iid", "left_semi")
    return cells, known.join(geno.select("iid").distinct(), "iid", "left_semi")


@dataclass
class Moments:
    """Products of z-scored markers and centred y on the driver (p bounded)."""

    markers: np.ndarray
    ztz: np.ndarray
    zty: np.ndarray
    yty: float
    n: float


def marker_moments(geno: DataFrame, pheno: DataFrame) -> Moments:
    """Z'Z and Z'y from integer sums of dosages; the z-scores are never formed.

    The dosage products are one tile product over markers; means and sds enter at the end.
    """
    y = F.col("y")
    pheno = pheno.where("y is not null")
    both = geno.join(pheno.select("iid"), "iid", "left_semi")
    info = materialise(
        geno.join(pheno, "iid").groupBy("marker").agg(
            F.count(F.lit(1)).alias("n"), F.sum(observed("dosage")).alias("s1"),
            F.sum(observed("dosage") * y).alias("sxy"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy")))
    rows = collect_bounded(info.orderBy("marker"), MAX_DRIVER_SIDE, "markers of a direct solve")
    ids = np.array([r.marker for r in rows], np.int64)
    n, sy, syy = float(rows[0].n), float(rows[0].sy), float(rows[0].syy)
    mean = np.array([float(r.s1) for r in rows]) / n
    full = dense_triangle(gram(both, "marker", "iid", "dosage", rows=ROWS, cols=4 * COLS), ids)
    centred = full - n * np.outer(mean, mean)
    sd = np.sqrt(np.diag(centred) / n)
    sd = np.where(sd == 0, 1.0, sd)
    sxy = np.array([float(r.sxy) for r in rows])
    return Moments(ids, centred / np.outer(sd, sd), (sxy - mean * sy) / sd, syy - sy * sy / n, n)


def _effects(spark, markers, beta) -> DataFrame:
    return spark.createDataFrame(pa.table({
        "marker": pa.array(markers, pa.int32()), "beta": pa.array(np.asarray(beta, float), pa.float64())}))


def solve_ridge(mom: Moments, delta: float, scale: np.ndarray | None = None) -> np.ndarray:
    """Effects of a direct solve; with column scales ``d`` the prior variance of marker j is ``d_j^2``."""
    d = np.ones(len(mom.zty)) if scale is None else scale
    system = mom.ztz * np.outer(d, d) + delta * np.eye(len(d))
    return d * np.linalg.solve(system, d * mom.zty)


def ridge(geno: DataFrame, pheno: DataFrame, delta: float) -> DataFrame:
    """Effects from the p x p system (p bounded); y is used as given, around its mean."""
    mom = marker_moments(geno, pheno)
    return _effects(geno.sparkSession, mom.markers, solve_ridge(mom, delta))


def ridge_scaled(geno: DataFrame, pheno: DataFrame, scales: DataFrame, delta: float, method: str = "gradients") -> DataFrame:
    """Effects with a scale per marker ``(marker, d)``: marker j shrinks by ``delta / d_j^2``.

    Markers without a scale get effect 0. ``method``: ``gradients`` for any size, or ``direct`` with p bounded.
    """
    if method == "gradients":
        return ridge_cg(geno, pheno, delta, scales=scales)
    if method != "direct":
        raise ValueError(f"unknown method {method}")
    mom = marker_moments(geno, pheno)
    known = {r.marker: r.d for r in collect_bounded(scales.select("marker", "d"), MAX_DRIVER_SIDE, "marker scales")}
    d = np.array([known.get(int(m), 0.0) for m in mom.markers])
    return _effects(geno.sparkSession, mom.markers, solve_ridge(mom, delta, d))


def ridge_hetero(geno: DataFrame, pheno: DataFrame, priors: DataFrame, h2: float, method: str = "gradients") -> DataFrame:
    """Heteroskedastic ridge: prior effects ``(marker, beta)`` give marker variance beta^2 / (1 - h2)."""
    scales = priors.select("marker", (F.abs("beta") / F.lit(float(np.sqrt(1.0 - h2)))).alias("d"))
    return ridge_scaled(geno, pheno, scales, (1.0 - h2) / h2, method)


def ridge_by_lambda(geno: DataFrame, pheno: DataFrame, lambdas: DataFrame, method: str = "gradients") -> DataFrame:
    """One shrinkage per marker ``(marker, lambda)``, e.g. inherited from regions."""
    return ridge_scaled(geno, pheno, lambdas.select("marker", (1.0 / F.sqrt("lambda")).alias("d")), 1.0, method)


def ridge_dual(geno: DataFrame, pheno: DataFrame, delta: float) -> DataFrame:
    """Effects from the n x n system: ``a = (ZZ' + delta I)^-1 y`` and ``beta = Z'a``.

    Up to ``MAX_DRIVER_SIDE`` individuals the system is solved on the driver, and the effects are one partial aggregate per marker over
    genotypes joined to ``a``. Beyond, ``a`` comes from conjugate gradients: the products of individuals are never formed, only multiplied with.
    """
    both, present = people(geno, pheno)
    params = materialise(scale_params(both))
    present = materialise(present)
    if present.count() > MAX_DRIVER_SIDE:
        return _dual_gradients(both, present, params, delta)
    rows = present.collect()
    ids = np.array(sorted(r.iid for r in rows), np.int64)
    y = np.zeros(len(ids))
    y[np.searchsorted(ids, [r.iid for r in rows])] = [r.y for r in rows]
    cells = both.join(params, "marker").select("iid", "marker", "dosage", "mean", "sd")
    zzt = dense_triangle(gram(both, "iid", "marker", "dosage", params), ids)
    a = np.linalg.solve(zzt + delta * np.eye(len(ids)), y - y.mean())
    dual = geno.sparkSession.createDataFrame(pa.table({"iid": pa.array(ids), "a": pa.array(a)}))
    z = (observed("dosage") - F.col("mean")) / F.col("sd")
    return cells.join(dual, "iid").groupBy("marker").agg(F.sum(z * F.col("a")).alias("beta"))


def _dual_gradients(cells: DataFrame, pheno: DataFrame, params: DataFrame, delta: float, tolerance: float = 1e-12, max_steps: int = 2000) -> DataFrame:
    """The dual system by conjugate gradients on tiles; markers are numbered densely, so that tiles hold no empty columns."""
    named = materialise(index_by_integer(params, "marker"))
    p = named.count()
    cols = min(max(p, 1), COLS)
    numbered = cells.join(F.broadcast(named.select("marker", "idx")) if p <= MAX_DRIVER_SIDE else named.select("marker", "idx"), "marker")
    tiles = materialise(tile_table(numbered, "iid", "idx", "dosage", ROWS, cols, named.select("idx", "mean", "sd")))
    shape = block_counts(tiles)
    mean_y = pheno.agg(F.avg("y")).first()[0]
    y = to_blocks(pheno.select("iid", (F.col("y") - F.lit(mean_y)).alias("y")), "iid", "y", ROWS)
    start = materialise(y.select("block", F.transform("v", lambda _: F.lit(0.0)).alias("x"), F.col("v").alias("r"), F.col("v").alias("p")))

    def multiply(direction: DataFrame) -> DataFrame:
        across = tile_times(tiles, shape, direction, ROWS, cols, transpose=True)
        return tile_times(tiles, shape, across, ROWS, cols, transpose=False)

    solved = _steps(start, multiply, delta, tolerance, max_steps)
    effects = tile_times(tiles, shape, solved.select("block", F.col("x").alias("v")), ROWS, cols, transpose=True)
    return from_blocks(effects, "v", cols, "idx", "beta").join(named.select("marker", "idx"), "idx").select("marker", "beta")


def ridge_observation_weighted(geno: DataFrame, pheno: DataFrame, weights: DataFrame, delta: float,
                               weight_outcome: bool = True) -> DataFrame:
    """``(Z'WZ + delta I)^-1 Z'Wy`` with weights per individual ``(iid, w)``.

    ``weight_outcome=False`` leaves W out of the right side. Both sides run over those with genotypes, phenotype and weight. The system is
    solved exactly: on the driver where it is small, else by blocked Cholesky factors, with the same result.
    """
    pheno = pheno.join(weights.where("w is not null").select("iid"), "iid", "left_semi")
    both, pheno = people(geno, pheno)
    params = materialise(scale_params(both))
    z = ((observed("dosage") - F.col("mean")) / F.col("sd")).alias("z")
    cells = both.join(params, "marker").join(weights, "iid").select("iid", "marker", z, "w")
    root = cells.select("iid", "marker", (F.col("z") * F.sqrt("w")).alias("v"))
    factor = F.col("w") if weight_outcome else F.lit(1.0)
    right = cells.join(pheno, "iid").groupBy("marker").agg(F.sum(F.col("z") * factor * F.col("y")).alias("r"))
    if params.count() > MAX_DRIVER_SIDE:
        blocks, names, p = numbered_gram(materialise(root), "marker", "v")
        solved = cholesky.solve(blocks, right.join(names, "marker").select("idx", F.col("r").alias("v")), p, delta)
        return solved.join(names, "idx").select(F.col("marker").cast("int").alias("marker"), "beta")
    ids = np.array(sorted(r.marker for r in collect_bounded(params.select("marker"), MAX_DRIVER_SIDE, "markers")))
    ztwz = dense_triangle(gram(root, "marker", "iid", "v"), ids)
    known = {r.marker: r.r for r in right.collect()}
    zty = np.array([known[int(m)] for m in ids])
    return _effects(geno.sparkSession, ids, np.linalg.solve(ztwz + delta * np.eye(len(ids)), zty))


def tile_times(tiles: DataFrame, shape: tuple[int, int], vectors: DataFrame, rows: int, cols: int, transpose: bool,
               width: int = 1) -> DataFrame:
    """One product of the tile table with ``width`` blocked vectors ``(block, v)``; result ``(block, v)``.

    ``shape`` is the number of row and column blocks and bounds the vectors' size: below
    ``VECTOR_BYTES`` they are broadcast and the tiles stay where they are, above it they are joined. A
    task adds up the blocks it meets before it sends them on, so what is shuffled is at most one block
    per task and output block.
    """
    near, size = ("rb", cols) if transpose else ("cb", rows)
    length = shape[0] * rows if transpose else shape[1] * cols
    side = vectors.withColumnRenamed("block", near)
    if 8 * length * width <= VECTOR_BYTES:
        side = F.broadcast(side)
    joined = tiles.join(side, near).select("rb", "cb", "x", "mu", "inv", "v")

    def multiply(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for rb, cb, x, mu, inv, v in zip(*(batch.column(n).to_pylist() for n in ("rb", "cb", "x", "mu", "inv", "v"))):
                values, _, _ = decode(x, mu, inv, rows, cols)
                many = np.asarray(v).reshape(-1, width)
                out = ((values.T if transpose else values) @ many).ravel()
                key = cb if transpose else rb
                sums[key] = sums[key] + out if key in sums else out
                if len(sums) > 1024:
                    yield _blocks(sums)
                    sums = {}
        if sums:
            yield _blocks(sums)

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * width)
        for batch in batches:  # a block at a time: the partial vectors of a group are never held together
            for v in batch.column("v"):
                total += v.values.to_numpy()
        yield pa.record_batch({"block": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([total], pa.list_(pa.float64()))})

    add.__annotations__ = {"key": tuple, "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    parts = joined.mapInArrow(multiply, "block int, v array<double>")
    return parts.groupBy("block").applyInArrow(add, "block int, v array<double>")


def _blocks(sums):
    return pa.record_batch({"block": pa.array(list(sums), pa.int32()),
                            "v": pa.array(list(sums.values()), pa.list_(pa.float64()))})


def to_blocks(long: DataFrame, key: str, value: str, size: int) -> DataFrame:
    """A long vector in blocks of ``size`` values, absent positions 0 (a group is one block)."""
    keyed = long.select(F.floor(F.col(key) / size).cast("int").alias("block"),
                        F.pmod(F.col(key), F.lit(size)).cast("int").alias("at"), F.col(value).cast("double").alias("v"))

    def pack(group, table):
        out = np.zeros(size)
        out[table.column("at").to_numpy()] = table.column("v").to_numpy()
        return pa.table({"block": pa.array([group[0].as_py()], pa.int32()), "v": pa.array([out], pa.list_(pa.float64()))})

    return keyed.groupBy("block").applyInArrow(pack, "block int, v array<double>")


def from_blocks(blocks: DataFrame, column: str, size: int, key: str, value: str) -> DataFrame:
    return blocks.select("block", F.posexplode(column).alias("at", value)).select(
        (F.col("block") * size + F.col("at")).cast("int").alias(key), value)


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)


def _axpy(a: str, b: str, factor: float):
    return F.zip_with(a, b, lambda p, q: p + F.lit(float(factor)) * q)


def ridge_cg(geno: DataFrame, pheno: DataFrame, delta: float, tolerance: float = 1e-10, max_steps: int = 1000,
             rows: int = ROWS, cols: int = COLS, scales: DataFrame | None = None) -> DataFrame:
    """Effects by conjugate gradients: only scalars reach the driver, any n and p.

    A step is two products with the tile table; vectors stay blocked tables written to scratch,
    so a lost executor repeats one step at most. Scales per marker ``(marker, d)`` are folded into
    the sd of the columns. Raises when ``max_steps`` do not reach the tolerance.
    """
    cells, present = people(geno, pheno)
    pheno = materialise(present)
    params = materialise(_folded(scale_params(cells), scales))
    used = params.filter("d <> 0").select("marker", "mean", (F.col("sd") / F.col("d")).alias("sd"))
    if scales is not None:
        cells = cells.join(used.select("marker"), "marker", "left_semi")
    tiles = materialise(tile_table(cells, "iid", "marker", "dosage", rows, cols, used))
    return _gradients(tiles, pheno, params, delta, tolerance, max_steps, rows, cols)


def ridge_cg_tiles(tiles: DataFrame, pheno: DataFrame, params: DataFrame, delta: float, tolerance: float = 1e-10,
                   max_steps: int = 1000, rows: int = ROWS, cols: int = COLS, scales: DataFrame | None = None) -> DataFrame:
    """The same from a raw tile table and ``params(marker, mean, sd)`` of the markers to use; everyone in
    the tiles has a phenotype."""
    folded = materialise(_folded(params, scales))
    used = folded.filter("d <> 0").select("marker", "mean", (F.col("sd") / F.col("d")).alias("sd"))
    return _gradients(materialise(with_stats(tiles, used, cols=cols)), pheno, folded, delta, tolerance, max_steps, rows, cols)


def _folded(params: DataFrame, scales: DataFrame | None) -> DataFrame:
    if scales is None:
        return params.select("marker", "mean", "sd", F.lit(1.0).alias("d"))
    return params.join(scales.select("marker", "d"), "marker", "left").select(
        "marker", "mean", "sd", F.coalesce("d", F.lit(0.0)).alias("d"))


def _steps(state: DataFrame, multiply, delta: float, tolerance: float, max_steps: int) -> DataFrame:
    """Conjugate gradients from ``state(block, x, r, p)`` for a matrix plus ``delta`` on its diagonal; ``multiply`` maps blocks ``(block, v)`` to its
    product with the matrix."""
    rr = start = state.agg(F.sum(_dot("r", "r"))).first()[0]
    for _ in range(max_steps):
        if rr is None or rr <= tolerance * tolerance * start:
            break
        direction = state.select("block", F.col("p").alias("v"))
        joined = materialise(state.join(multiply(direction), "block").withColumn("q", _axpy("v", "p", delta)).drop("v"))
        step = rr / joined.agg(F.sum(_dot("p", "q"))).first()[0]
        moved = joined.select("block", _axpy("x", "p", step).alias("x"), _axpy("r", "q", -step).alias("r"), "p")
        new = moved.agg(F.sum(_dot("r", "r"))).first()[0]
        ratio, rr = new / rr, new
        before, state = state, materialise(moved.select("block", "x", "r", _axpy("r", "p", ratio).alias("p")))
        discard(before, joined)
    else:
        if rr > tolerance * tolerance * start:
            raise ValueError(f"no convergence in {max_steps} steps (residual {(rr / start) ** 0.5:.1e})")
    return state


def _gradients(tiles, pheno, params, delta, tolerance, max_steps, rows, cols) -> DataFrame:
    shape = block_counts(tiles)
    mean_y = pheno.agg(F.avg("y")).first()[0]
    y = to_blocks(pheno.select("iid", (F.col("y") - F.lit(mean_y)).alias("y")), "iid", "y", rows)
    right = tile_times(tiles, shape, y, rows, cols, transpose=True)
    state = materialise(right.select("block", F.transform("v", lambda _: F.lit(0.0)).alias("x"),
                                     F.col("v").alias("r"), F.col("v").alias("p")))

    def multiply(direction: DataFrame) -> DataFrame:
        across = tile_times(tiles, shape, direction, rows, cols, transpose=False)
        return tile_times(tiles, shape, across, rows, cols, transpose=True)

    state = _steps(state, multiply, delta, tolerance, max_steps)
    effects = from_blocks(state, "x", cols, "marker", "beta")
    return params.select("marker", "d").join(effects, "marker", "left").select(
        "marker", (F.col("d") * F.coalesce("beta", F.lit(0.0))).alias("beta"))


def fit_effects(geno: DataFrame, pheno: DataFrame, delta: float, method: str = "gradients") -> DataFrame:
    """Ridge effects by ``method``, whatever the sizes: ``gradients`` (no bound), the exact small system ``markers`` (p bounded), or the dual
    one, ``individuals``. ``delta = -1`` is plain least squares without the intercept's coefficient."""
    if delta == -1:
        geno, present = people(geno, pheno)
        params = materialise(scale_params(geno))
        if present.count() < params.count():
            raise ValueError("more markers than individuals: a shrinkage is required")
        z = ((observed("dosage") - F.col("mean")) / F.col("sd")).alias("value")
        cells = geno.join(params, "marker").select("iid", F.col("marker").alias("term"), z)
        return multi_reg(cells, pheno).filter("term >= 0").select(F.col("term").alias("marker"), "beta")
    ways = {"gradients": ridge_cg, "markers": ridge, "individuals": ridge_dual}
    if method not in ways:
        raise ValueError(f"unknown method {method}")
    return ways[method](geno, pheno, delta)
