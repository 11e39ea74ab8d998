"""Relationship matrices in factors, against dense matrices and against tiles."""

import numpy as np
import pytest
from conftest import by_marker
from pyspark.sql import functions as F

from locusframe.operators import grm_factors, grm_tiles, kinship, reml, ridge
from locusframe.operators import haseman_elston as he
from locusframe.plans import jobs


def matrix_of(sums, count):
    return he.cross_product_matrix(sums, he.component_names(count))


def dense_sums(matrices, y):
    at = np.tril_indices(len(y), -1)
    design = np.stack([np.ones(len(at[0])), *(k[at] for k in matrices), ((y[:, None] - y[None]) ** 2)[at]])
    return design @ design.T


def covariates_of(spark, panel):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((panel.n, 2))
    cells = spark.createDataFrame([(i, c, float(x[i, c])) for i in range(panel.n) for c in range(2)], "iid long, cov int, value double")
    return x, cells


def test_factors_hold_the_matrix(spark, panel):
    """traces without pairs; individuals far apart and of several blocks."""
    k = panel.z @ panel.z.T / panel.p
    far = panel.geno.select((F.col("iid") * 40 + 7).alias("iid"), (F.col("marker") * 3000).alias("marker"), "dosage")
    grm = kinship.kinship_additive(far, form="factors")
    assert sorted(r.iid for r in grm_factors.individuals(grm).collect()) == [i * 40 + 7 for i in range(panel.n)]
    t = kinship.trace_stats(grm).first()
    assert t.n == panel.n and abs(t.trace - np.trace(k)) < 1e-9 and abs(t.sum_sq - (k**2).sum()) < 1e-8
    got = {(r.i, r.j): r.k for r in grm_tiles.pairs(grm_factors.as_tiles(grm)).collect()}
    assert len(got) == panel.n * (panel.n + 1) // 2 and all(abs(v - k[i // 40, j // 40]) < 1e-10 for (i, j), v in got.items())


def test_he_sums_never_compute_pairs_where_markers_are_few(monkeypatch, spark, panel):
    """Before, every pair was computed."""
    x, covariates = covariates_of(spark, panel)
    monkeypatch.setattr(he, "row_gram", None)
    monkeypatch.setattr(grm_factors, "row_gram", None)
    k = panel.z @ panel.z.T / panel.p
    dom = np.where(panel.m == 2, 1, panel.m)
    dom = (dom - dom.mean(0)) / dom.std(0)
    c = (x - x.mean(0)) / x.std(0)
    grm = kinship.kinship_additive(panel.geno, form="factors")
    assert np.allclose(matrix_of(he.cross_products(grm, panel.pheno, 3), 3), dense_sums([k, k**2, k**3], panel.y))
    want = dense_sums([k, k**2, dom @ dom.T / panel.p, c @ c.T / 2], panel.y)
    assert np.allclose(matrix_of(he.cross_products_from_genotypes(panel.geno, panel.pheno, 2, True, covariates), 4), want)
    some, rows = panel.pheno.where("iid % 3 <> 0"), np.arange(panel.n) % 3 != 0
    part = k[np.ix_(rows, rows)]  # a stored matrix keeps the scale of all
    assert np.allclose(matrix_of(he.cross_products(grm, some, 2), 2), dense_sums([part, part**2], panel.y[rows]))


def test_too_many_markers_go_by_tiles(monkeypatch, panel):
    k = panel.z @ panel.z.T / panel.p
    want = dense_sums([k, k**2], panel.y)
    monkeypatch.setattr(grm_factors, "MAX_DRIVER_SIDE", panel.p + 3)  # the markers fit, their squares don't
    assert np.allclose(matrix_of(he.cross_products(kinship.kinship_additive(panel.geno, form="factors"), panel.pheno, 2), 2), want)
    assert np.allclose(matrix_of(he.cross_products_from_genotypes(panel.geno, panel.pheno, 2), 2), want)
    monkeypatch.setattr(grm_factors, "MAX_DRIVER_SIDE", panel.p - 1)
    grm = kinship.kinship_additive(panel.geno, form="factors")
    assert grm_tiles.is_tiled(grm) and np.allclose(matrix_of(he.cross_products(grm, panel.pheno, 2), 2), want)


@pytest.mark.parametrize("some", [False, True])
def test_exact_reml_has_no_bound_on_people(monkeypatch, spark, panel, some):
    """more people than the driver's bound were an error."""
    pheno = panel.pheno.where("iid % 3 <> 0") if some else panel.pheno
    dense = kinship.kinship_additive(panel.geno)
    x, covariates = covariates_of(spark, panel)
    want = jobs.heritability(pheno, grm=dense, method="exact").first()
    wide = jobs.heritability(pheno, grm=dense, method="exact", covariates=covariates).first()
    monkeypatch.setattr(reml, "MAX_DRIVER_SIDE", panel.p + 2)
    with pytest.raises(ValueError, match="driver"):
        jobs.heritability(pheno, grm=dense, method="exact")
    grm = kinship.kinship_additive(panel.geno, form="factors")
    eig = reml.eigen_summary(grm, jobs.trait(pheno, grm_factors.individuals(grm)))
    for got, other in ((jobs.heritability(pheno, grm=grm, method="exact"), want), (jobs.heritability(pheno, eig=eig), want),
                       (jobs.heritability(pheno, grm=grm, method="exact", covariates=covariates), wide)):
        got = got.first()
        for c in ("h2", "h2_se", "vg", "ve", "reml_ll", "n", "y_ss"):
            assert abs(got[c] - other[c]) < 1e-6 * max(1, abs(other[c])), c
        assert abs(np.log(got.delta / other.delta)) < 1e-6


def test_dual_ridge_has_no_bound_on_people(monkeypatch, panel):
    """More people than the driver's bound were an error."""
    some = panel.pheno.where("iid % 3 <> 0")
    for pheno in (panel.pheno, some):
        want = by_marker(ridge.ridge_dual(panel.geno, pheno, 1.5))
        monkeypatch.setattr(ridge, "MAX_DRIVER_SIDE", 10)
        got = ridge.ridge_dual(panel.geno, pheno, 1.5)
        assert dict(got.dtypes)["marker"] == "int" and np.abs(by_marker(got) - want).max() < 1e-9
        monkeypatch.undo()


@pytest.mark.parametrize("steps", [6, 60])
def test_lanczos_in_coordinates_is_the_same_recurrence(monkeypatch, spark, panel, steps):
    """vectors as long as there are people were stored at every step."""
    _, covariates = covariates_of(spark, panel)
    twice = covariates.unionByName(covariates.where("cov = 0").withColumn("cov", F.lit(5)))  # a term that follows from another
    got = reml.reml_lanczos(panel.geno, panel.pheno, steps, 5, covariates=twice).first()
    monkeypatch.setattr(grm_factors, "factored", lambda *_: None)
    want = reml.reml_lanczos(panel.geno, panel.pheno, min(steps, 30), 5, covariates=twice).first()
    for c in ("h2", "vg", "ve", "reml_ll", "n", "y_ss", "n_fixed"):
        assert abs(got[c] - want[c]) < 1e-5 * max(1, abs(want[c])), c


def test_rows_that_repeat_people_count_as_in_a_dense_fit(panel):
    pheno = panel.pheno.unionByName(panel.pheno.where("iid % 9 = 0"))
    forms = [kinship.kinship_additive(panel.geno, form=form) for form in ("pairs", "factors")]
    fits = [[jobs.heritability(pheno, grm=g, method="exact").first() for g in forms],
            [jobs.heritability(pheno, eig=reml.eigen_summary(g, pheno)).first() for g in forms]]
    for want, got in fits:
        assert want.n == got.n == panel.n + 7
        for c in ("h2", "h2_se", "vg", "ve", "reml_ll"):
            assert abs(got[c] - want[c]) < 1e-6 * max(1, abs(want[c])), c


def test_merged_factors_are_factors(spark, panel, monkeypatch):
    """F8: a merge writes no value of a matrix; people that one part lacks leave, parts of other numbers and too many markers are merged as well."""
    far = panel.geno.select((F.col("iid") * 40 + 7).alias("iid"), "marker", "dosage")
    k = panel.z @ panel.z.T / panel.p
    for lost, kind in ((None, "int"), (5, "int"), (5, "double")):
        second = far.where("marker >= 9").where(F.lit(True) if lost is None else F.col("iid") != lost * 40 + 7)
        parts = [far.where("marker < 9"), second.withColumn("dosage", F.col("dosage").cast(kind))]
        factors = [kinship.kinship_additive(x, form="factors") for x in parts]
        merged = kinship.merge_kinships(factors)
        assert isinstance(merged, grm_factors.Factors) and merged.p == panel.p and merged.markers.select("idx").distinct().count() == panel.p
        got = {(r.i, r.j): (r.k, r.n_snps) for r in kinship.long_rows(merged).collect()}
        n = panel.n - (lost is not None)
        assert len(got) == n * (n + 1) // 2 and not any(lost is not None and lost * 40 + 7 in at for at in got)
        want = {(r.i, r.j): (r.k, r.n_snps) for r in grm_tiles.pairs(kinship.merge_kinships([kinship.kinship_additive(x, form="tiles") for x in parts])).collect()}
        assert got.keys() == want.keys() and all(abs(v[0] - want[at][0]) < 1e-10 and v[1] == want[at][1] == panel.p for at, v in got.items())
        if lost is None:
            assert all(abs(v[0] - k[i // 40, j // 40]) < 1e-10 for (i, j), v in got.items())
    monkeypatch.setattr(grm_factors, "MAX_DRIVER_SIDE", panel.p - 1)
    assert grm_tiles.is_tiled(tiles := kinship.merge_kinships(factors)) and len(got) == kinship.long_rows(tiles).count()
