"""Haseman-Elston regression of squared phenotype differences on relatedness.

Every nested model follows from one cross-product matrix over pairs, whose (k + 2)^2 sums are all that reaches the driver. They come from
stored matrices tile by tile, or straight from genotypes and covariates: the tile tables of all components stream
through one product, and each block of pairs is reduced where it is computed. No pair is ever a row. Where markers are few, the sums follow from
products of markers (``grm_factors``) and no pair is computed at all.

The people of a fit are those with a phenotype who are in all matrices.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.operators import grm_factors, grm_tiles
from locusframe.operators.align import complete_cases
from locusframe.operators.kinship import covariate_stats
from locusframe.operators.regression import solve_least_squares
from locusframe.operators.tiles import row_gram, stacked, tile_table, with_side
from locusframe.operators.transform import dominance_recode, scale_params
from locusframe.session import materialise

SIGNIFICANT = 0.05


def _labels(names: list[str]) -> list[str]:
    return ["1", *names, "z"]


def _products(columns: list[np.ndarray], z: np.ndarray) -> np.ndarray:
    """Upper triangle of the products of (1, columns.., z), flat."""
    design = np.stack([np.ones_like(z), *columns, z])
    return (design @ design.T)[np.triu_indices(len(design))]


def _components(matrices: list[np.ndarray], epi: int) -> list[np.ndarray]:
    """The first matrix, its powers 2..epi, and the others."""
    return [matrices[0], *(matrices[0] ** k for k in range(2, epi + 1)), *matrices[1:]]


def _sum_rows(spark, sums: np.ndarray, names: list[str]) -> DataFrame:
    labels = _labels(names)
    a, b = np.triu_indices(len(labels))
    return spark.createDataFrame([(labels[i], labels[j], float(s)) for i, j, s in zip(a, b, sums)], "a string, b string, s double")


def _sum_matrix_rows(spark, sums: np.ndarray, names: list[str]) -> DataFrame:
    return _sum_rows(spark, sums[np.triu_indices(len(sums))], names)


def _is_factored(grm) -> bool:
    return isinstance(grm, grm_factors.Factors)


def component_names(epi: int, further: int = 0) -> list[str]:
    return [f"x{k}" for k in range(1, epi + further + 1)]


def cross_products(grm: DataFrame, pheno: DataFrame, epi: int = 1, further: list[DataFrame] | None = None) -> DataFrame:
    """Sums of products of (1, x1..xk, z) over all pairs j < i of stored matrices as rows ``(a, b, s)``, ``a <= b``.

    x1 is the value of ``grm``, then come its powers 2..epi and the values of ``further`` matrices; ``z = (y_i - y_j)^2``. Matrices are
    factors, tile tables, or long rows that are packed into tiles first; beside tiles, or with too many columns, factors become tiles.
    """
    matrices = [grm, *(further or [])]
    if all(map(_is_factored, matrices)) and not grm_factors.too_many(matrices, epi):
        return _sum_matrix_rows(grm.sparkSession, grm_factors.pair_sums(matrices, pheno, epi), component_names(epi, len(matrices) - 1))
    matrices = [grm_factors.as_tiles(g) if _is_factored(g) else grm_tiles.tiled(g) for g in matrices]
    joined = matrices[0].select("rb", "cb", F.col("k").alias("k0"))
    for c, other in enumerate(matrices[1:], 1):
        joined = joined.join(other.select("rb", "cb", F.col("k").alias(f"k{c}")), ["rb", "cb"])
    names = component_names(epi, len(matrices) - 1)
    count = len(matrices)

    def of(row: dict) -> np.ndarray:
        values = [grm_tiles.values_of(row[f"k{c}"]) for c in range(count)]
        z = (np.frombuffer(row["vi"])[:, None] - np.frombuffer(row["vj"])[None]) ** 2
        known = ~np.isnan(z)
        for v in values:
            known &= ~np.isnan(v)
        known &= (row["rb"] * grm_tiles.TILE_ROWS + np.arange(grm_tiles.TILE_ROWS))[:, None] != (
            row["cb"] * grm_tiles.TILE_COLS + np.arange(grm_tiles.TILE_COLS))[None]
        return _products(_components([v[known] for v in values], epi), z[known])

    cells = len(np.triu_indices(len(names) + 2)[0])
    sums = grm_tiles.summed(grm_tiles.beside(joined, pheno, "y"), of, [str(c) for c in range(cells)])
    return _sum_rows(grm.sparkSession, np.array(list(sums.values())), names)


def people(geno: DataFrame, pheno: DataFrame, covariates: DataFrame | None = None) -> DataFrame:
    """Those with any genotype, a phenotype and every covariate: ``iid, y``."""
    known = pheno.filter(F.col("y").isNotNull()).select("iid", "y").join(geno.select("iid").distinct(), "iid", "left_semi")
    if covariates is not None:
        known = known.join(complete_cases(covariates), "iid", "left_semi")
    return materialise(known)


def cross_products_from_genotypes(geno: DataFrame, pheno: DataFrame, epi: int = 1, dominance: bool = False,
                                  covariates: DataFrame | None = None) -> DataFrame:
    """The same sums straight from genotypes: from products of markers where these are few, else blocks of all relationship matrices are reduced where they
    are computed, and no pair is ever written.

    Components: additive, its powers 2..epi, dominance, covariates ``(iid, cov, value)``. The people are those with genotypes, a phenotype and
    all covariates, also for the scale of the markers. The phenotypes travel in blocks beside the tiles.
    """
    known = people(geno, pheno, covariates)
    cells = geno.join(known.select("iid"), "iid", "left_semi")
    sources = [(source, "marker", "dosage", materialise(scale_params(source))) for source in [cells, *([dominance_recode(cells)] if dominance else [])]]
    if covariates is not None:
        given = covariates.where("value is not null").join(known.select("iid"), "iid", "left_semi").select(
            "iid", "cov", F.col("value").cast("double").alias("value"))
        sources.append((given, "cov", "value", covariate_stats(given)))
    factors = [grm_factors.factored(source, *named) for source, *named in sources]
    if all(map(_is_factored, factors)) and not grm_factors.too_many(factors, epi):
        return _sum_matrix_rows(geno.sparkSession, grm_factors.pair_sums(factors, known, epi), component_names(epi, len(sources) - 1))
    sizes = [stats.count() for *_, stats in sources]
    tables = [tile_table(source, "iid", col, value, stats=stats) for source, col, value, stats in sources]
    many = len(tables)
    names = component_names(epi, many - 1)

    def sums(i, j, block, yi, yj):
        block = block[None] if many == 1 else block
        keep = j[None] < i[:, None]
        z = ((yi[:, None] - yj[None]) ** 2)[keep]
        s = _products(_components([block[c][keep] / sizes[c] for c in range(many)], epi), z)
        return pa.record_batch({"label": pa.array(range(len(s)), pa.int32()), "s": s})

    tiles = stacked(tables) if many > 1 else tables[0]
    tiles = materialise(with_side(tiles, known, "iid", "y"))
    parts = row_gram(tiles, emit=sums, schema="label int, s double", parts=many)
    found = {r.label: r.s for r in parts.groupBy("label").agg(F.sum("s").alias("s")).collect()}
    cells_of = len(np.triu_indices(len(names) + 2)[0])
    return _sum_rows(geno.sparkSession, np.array([found.get(c, 0.0) for c in range(cells_of)]), names)


def cross_product_matrix(sums: DataFrame, names: list[str]) -> np.ndarray:
    where = {label: k for k, label in enumerate(_labels(names))}
    m = np.zeros((len(where), len(where)))
    for a, b, s in sums.collect():
        m[where[a], where[b]] = m[where[b], where[a]] = s
    return m


def residualise(m: np.ndarray) -> np.ndarray:
    """Cross products after each predictor past the first is replaced by its residuals on the
    intercept and the predictors before it."""
    out = m.copy()
    for c in range(2, len(m) - 1):
        step = np.eye(len(m))
        step[:c, c] = -np.linalg.solve(out[:c, :c], out[:c, c])
        out = step.T @ out @ step
    return out


def component_labels(epi: int, dominance: bool = False, further: list[str] | None = None) -> list[str]:
    return (["additive"] + [f"epistasis {k}-way" for k in range(2, epi + 1)] + (["dominance"] if dominance else [])
            + list(further or []))


def fit_models(m: np.ndarray, var_y: float, labels: list[str], smallest: int = 0) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Nested models of 0..k components: model table and component table."""
    n, k = m[0, 0], len(m) - 2
    models, parts = [], []
    for size in range(smallest, k + 1):
        take = [*range(size + 1), k + 1]
        fit = solve_least_squares(m[np.ix_(take, take)], n, bonferroni=True)
        vc, se, p = -0.5 * fit["beta"][1:], 0.5 * fit["se"][1:], fit["p"][1:]
        hit = p <= SIGNIFICANT
        total, spread = vc[hit].sum(), 1.96 * se[hit].sum()
        bic = n + n * np.log(2 * np.pi) + n * np.log(fit["sse"] / n) + np.log(n) * (size + 2)
        models.append((size, bic, total / var_y, (total - spread) / var_y, (total + spread) / var_y, var_y - total))
        parts.extend((size, c + 1, labels[c], vc[c], p[c], se[c]) for c in range(size))
    return (pd.DataFrame(models, columns=["components", "bic", "h2", "h2_lb", "h2_ub", "ve"]),
            pd.DataFrame(parts, columns=["components", "component", "label", "vc", "p", "vc_se"]))


MODEL_SCHEMA = "components int, bic double, h2 double, h2_lb double, h2_ub double, ve double"
PART_SCHEMA = "components int, component int, label string, vc double, p double, vc_se double"


def _tables(spark, sums: DataFrame, names: list[str], var_y: float, labels: list[str], residual: bool, smallest: int) -> tuple[DataFrame, DataFrame]:
    m = cross_product_matrix(sums, names)
    models, parts = fit_models(residualise(m) if residual else m, var_y, labels, smallest)
    return spark.createDataFrame(models, MODEL_SCHEMA), spark.createDataFrame(parts, PART_SCHEMA)


def he_regression(grm: DataFrame, pheno: DataFrame, epi: int = 1, dominance: DataFrame | None = None,
                  residual: bool = False, further: list[DataFrame] | None = None, labels: list[str] | None = None,
                  only_full: bool = False) -> tuple[DataFrame, DataFrame]:
    """Variance-component models of stored matrices: ``vc_model`` and ``vc_component`` tables.

    All nested models, or with ``only_full`` the one with all components. ``further`` matrices have their ``labels``.
    """
    others = [*([dominance] if dominance is not None else []), *(further or [])]
    matrices = [g if _is_factored(g) or grm_tiles.is_tiled(g) else materialise(grm_tiles.tiled(g)) for g in [grm, *others]]
    known = pheno.filter(F.col("y").isNotNull()).select("iid", "y")
    for m in matrices:
        known = known.join(grm_factors.individuals(m) if _is_factored(m) else grm_tiles.individuals(m), "iid", "left_semi")
    known = materialise(known)
    names = component_names(epi, len(others))
    var_y = known.agg(F.var_pop("y")).first()[0]
    return _tables(grm.sparkSession, cross_products(matrices[0], known, epi, matrices[1:]), names, var_y,
                   component_labels(epi, dominance is not None, labels), residual, len(names) if only_full else 0)


def he_regression_from_genotypes(geno: DataFrame, pheno: DataFrame, epi: int = 1, residual: bool = False, dominance: bool = False,
                                 covariates: DataFrame | None = None, only_full: bool = False) -> tuple[DataFrame, DataFrame]:
    """The same models without a stored relationship matrix; covariates are a further component."""
    names = component_names(epi, dominance + (covariates is not None))
    sums = cross_products_from_genotypes(geno, pheno, epi, dominance, covariates)
    var_y = people(geno, pheno, covariates).agg(F.var_pop("y")).first()[0]
    labels = component_labels(epi, dominance, ["covariates"] if covariates is not None else None)
    return _tables(geno.sparkSession, sums, names, var_y, labels, residual, len(names) if only_full else 0)
