"""Relationship matrices, as symmetric tile tables (``form="tiles"``, see ``grm_tiles``) or as long rows ``grm(i, j, k, n_snps)``, ``j <= i``.

With ``form="factors"`` additive and dominance matrices stay products of their markers (see ``grm_factors``), whose size is that of the
genotypes; where the markers are too many for that, the result is a tile table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.functions.scalar import maf_score
from locusframe.operators import grm_factors, grm_tiles
from locusframe.operators.qc import drop_zero_weights
from locusframe.operators.tiles import ROWS, fitting_cols, gram, lower_pairs, row_gram, with_stats
from locusframe.operators.transform import dominance_recode, scale_params
from locusframe.session import materialise


def _finish(value: Callable[[np.ndarray], np.ndarray], n_snps: float, form: str, digits: int | None = None) -> dict:
    """How ``row_gram`` writes a matrix whose values are a function of products. Long rows of values that will be rounded to ``digits`` come in the
    order in which they take least storage (``stored_order``)."""
    if form == "tiles":
        return {"emit": grm_tiles.tile_writer(value, n_snps), "schema": grm_tiles.SCHEMA}
    if form != "pairs":
        raise ValueError(f"unknown form {form}")

    def emit(i: np.ndarray, j: np.ndarray, block: np.ndarray) -> pa.RecordBatch:
        return rows(*lower_pairs(i, j, value(block)))

    def rows(i: np.ndarray, j: np.ndarray, k: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch({"i": i, "j": j, "k": k, "n_snps": np.full(len(k), n_snps)})

    return {"emit": emit, "schema": "i long, j long, k double, n_snps double", "sorting": None if digits is None else (value, rows, digits)}


def kinship_additive(geno: DataFrame, form: str = "pairs", digits: int | None = None) -> DataFrame | grm_factors.Factors:
    """Mean product of z-scores over markers, for every pair of individuals and the diagonal."""
    params = materialise(scale_params(geno))
    if form == "factors":
        found = grm_factors.factored(geno, "marker", "dosage", params)
        if found is not None:
            return found
        form = "tiles"
    p = params.count()
    return gram(geno, "iid", "marker", "dosage", params, cols=fitting_cols(params, "marker"), **_finish(lambda s: s / p, float(p), form, digits))


def kinship_from_tiles(tiles: DataFrame, params: DataFrame, form: str = "pairs", digits: int | None = None) -> DataFrame:
    """The additive matrix from a stored tile table and the parameters of the markers to use."""
    p = params.count()
    return row_gram(materialise(with_stats(tiles, params)), **_finish(lambda s: s / p, float(p), form, digits))


def kinship_dominance(geno: DataFrame, form: str = "pairs", digits: int | None = None) -> DataFrame:
    return kinship_additive(dominance_recode(geno), form, digits)


def marker_weights(report: DataFrame, ld_weights: DataFrame | None = None,
                   maf_alpha: float | None = None) -> DataFrame:
    """Weight per kept marker: score of its frequency, LD weight, or their product; zeros leave."""
    w = maf_score("maf", maf_alpha) if maf_alpha is not None else F.lit(1.0)
    out = report.filter(F.col("reason").isNull()).select("marker", w.alias("w"))
    if ld_weights is not None:
        out = out.join(ld_weights.select("marker", F.col("w").alias("_ld")), "marker").select(
            "marker", (F.col("w") * F.col("_ld")).alias("w"))
    return drop_zero_weights(out)


def kinship_weighted(geno: DataFrame, weights: DataFrame, mode: str = "post", dominance: bool = False,
                     form: str = "pairs", digits: int | None = None) -> DataFrame:
    """Relationship matrix with marker weights ``(marker, w)``.

    ``mode='reference'`` scales columns before they are standardised, where positive weights
    cancel, so only zero weights matter. ``mode='post'`` is the weighted mean of products,
    ``sum(w z z') / sum(w)``; the weight is folded into the column scale as its square root.
    """
    source = dominance_recode(geno) if dominance else geno
    used = materialise(drop_zero_weights(weights))
    if mode == "reference":
        return kinship_additive(source.join(used.select("marker"), "marker", "left_semi"), form, digits)
    params = materialise(scale_params(source).join(used, "marker").select(
        "marker", "mean", (F.col("sd") / F.sqrt("w")).alias("sd"), "w"))
    total, p = params.agg(F.sum("w"), F.count(F.lit(1))).first()
    cells = source.join(params.select("marker"), "marker", "left_semi")
    return gram(cells, "iid", "marker", "dosage", params, cols=fitting_cols(params, "marker"), **_finish(lambda s: s / total, float(p), form, digits))


def euclidean_distance(geno: DataFrame) -> DataFrame:
    """Euclidean distance of every two individuals' dosages, from exact integer products."""
    return gram(geno, "iid", "marker", "dosage", distance=True).select("i", "j", F.sqrt("s").alias("d"))


def kinship_gaussian(geno: DataFrame, theta: float = 0.5, form: str = "pairs", digits: int | None = None) -> DataFrame:
    """Gaussian kernel of the distance between z-scored individuals, scaled by marker count."""
    params = materialise(scale_params(geno))
    p = params.count()
    return gram(geno, "iid", "marker", "dosage", params, cols=fitting_cols(params, "marker"), distance=True,
                **_finish(lambda s: np.exp(-s / (4.0 * p * theta * theta)), float(p), form, digits))


def long_rows(grm: DataFrame | grm_factors.Factors, digits: int | None = None) -> DataFrame:
    """Long rows of a matrix in any form; those of factors are written where they are computed."""
    if not isinstance(grm, grm_factors.Factors):
        return grm_tiles.pairs(grm, digits) if grm_tiles.is_tiled(grm) else grm
    p = grm.p
    return row_gram(grm.tiles.withColumn("cb", F.lit(0)), ROWS, p, **_finish(lambda s: s / p, float(p), "pairs", digits))


def merge_kinships(grms: list[DataFrame | grm_factors.Factors]) -> DataFrame | grm_factors.Factors:
    """Average weighted by SNP counts over the pairs of ids present in all matrices.

    Factors give factors, for which no value of a matrix is written, unless they have too many markers; then and beside other forms they become tiles.
    Tile tables give a tile table, and long rows long rows; both meet tile by tile.
    """
    if all(isinstance(g, grm_factors.Factors) for g in grms):
        found = grm_factors.merged(grms)
        if found is not None:
            return found
    grms = [grm_factors.as_tiles(g) if isinstance(g, grm_factors.Factors) else g for g in grms]
    merged = grm_tiles.merge([grm_tiles.tiled(g) for g in grms])
    return merged if all(map(grm_tiles.is_tiled, grms)) else grm_tiles.pairs(merged)


def covariate_stats(covariates: DataFrame) -> DataFrame:
    """Mean and sd of each covariate, stored; a zero sd becomes 1."""
    return materialise(covariates.groupBy("cov").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("_sd")).select(
        "cov", "mean", F.when(F.col("_sd") == 0, 1.0).otherwise(F.col("_sd")).alias("sd")))


def covariate_kinship(covariates: DataFrame, form: str = "pairs", digits: int | None = None) -> DataFrame:
    """Relationship by z-scored covariates ``(iid, cov, value)``; ``cov`` is an integer position."""
    stats = covariate_stats(covariates)
    p = stats.count()
    cells = covariates.select("iid", "cov", F.col("value").cast("double").alias("value"))
    return gram(cells, "iid", "cov", "value", stats, cols=fitting_cols(stats, "cov"), **_finish(lambda s: s / p, float(p), form, digits))


def epistasis(grm: DataFrame, power: int) -> DataFrame:
    """Element-wise power of a relationship matrix."""
    if grm_tiles.is_tiled(grm):
        return grm_tiles.power(grm, power)
    return grm.withColumn("k", F.pow("k", F.lit(float(power))))


def trace_stats(grm: DataFrame | grm_factors.Factors) -> DataFrame:
    """n, trace and sum of squares over the full symmetric matrix, from factors, tiles or the stored triangle."""
    if isinstance(grm, grm_factors.Factors):
        return grm_factors.trace_stats(grm)
    if grm_tiles.is_tiled(grm):
        return grm_tiles.trace_stats(grm)
    off = F.col("i") != F.col("j")
    return grm.agg(
        F.count_if(~off).alias("n"),
        F.sum(F.when(~off, F.col("k"))).alias("trace"),
        F.sum(F.when(off, 2 * F.col("k") * F.col("k")).otherwise(F.col("k") * F.col("k"))).alias("sum_sq"))
