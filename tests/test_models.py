import math

import numpy as np
import pandas as pd
import pytest
from conftest import SF, by_marker, square
from pyspark.sql import functions as F

from locusframe import fixtures as fx
from locusframe.functions.tails import t_two_sided
from locusframe.operators import haseman_elston as he
from locusframe.operators import cholesky, grm_tiles, kinship, qc, regression, reml, ridge, scan, score, tiles, transform
from locusframe.plans import jobs


def _cells(panel):
    return panel.geno.select("iid", F.col("marker").alias("term"), F.greatest("dosage", F.lit(0)).cast("double").alias("value"))


def _ols(x, y):
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    sse = ((y - x @ beta) ** 2).sum()
    df = len(y) - x.shape[1]
    se = np.sqrt(sse / df * np.diag(inv))
    return beta, se, t_two_sided(beta / se, df), sse


def test_joint_and_single_regressions(panel):
    x = np.column_stack([np.ones(panel.n), panel.m])
    beta, se, p, sse = _ols(x, panel.y)
    got = regression.multi_reg(_cells(panel), panel.pheno).toPandas().sort_values("term")
    assert np.abs(got.beta - beta).max() < 1e-8 and np.abs(got.se - se).max() < 1e-8
    assert np.abs(got.p - p * len(p)).max() < 1e-7 and abs(got.sse.iloc[0] - sse) < 1e-8
    res = regression.squared_residuals(_cells(panel), panel.pheno, regression.multi_reg(_cells(panel), panel.pheno)).toPandas()
    assert abs(res.res.sum() - sse) < 1e-8
    uni = regression.uni_reg(panel.geno, panel.pheno, bonferroni=False).toPandas().set_index("marker")
    for m in (0, 7):
        b, s, q, _ = _ols(x[:, [0, m + 1]], panel.y)
        assert abs(uni.beta[m] - b[1]) < 1e-10 and abs(uni.se[m] - s[1]) < 1e-10 and abs(uni.p[m] - q[1]) < 1e-9
    assert uni.df[-1] == panel.n - 1
    few = _cells(panel).filter("iid < 20")
    one = regression.generic_reg(few, panel.pheno.filter("iid < 20"), 20, panel.p)
    assert one.count() == panel.p + 1
    pred = regression.predict_significant(_cells(panel), one, only_significant=False).count()
    assert pred == panel.n


def test_joint_regression_of_sparse_cells(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, (60, 4)).astype(float)
    x[:, :] *= rng.random(x.shape) < 0.4
    x[0], x[1:5, 0] = [0, 1, 2, 0], 0
    y = rng.standard_normal(60)
    there = x.any(1)
    cells = spark.createDataFrame([(int(i), int(t), float(x[i, t])) for i, t in zip(*np.nonzero(x))] + [(99, 1, 2.0)], "iid long, term int, value double")
    pheno = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "iid long, y double")
    beta, se, p, sse = _ols(np.column_stack([np.ones(there.sum()), x[there]]), y[there])
    got = regression.multi_reg(cells, pheno).toPandas().sort_values("term")
    assert np.allclose(got.beta, beta) and np.allclose(got.se, se) and np.allclose(got.p, p * 5) and (got.df == there.sum() - 5).all()
    res = regression.squared_residuals(cells, pheno, regression.multi_reg(cells, pheno)).toPandas()
    assert len(res) == there.sum() and abs(res.res.sum() - sse) < 1e-8


def _dense_reml(k, y, x):
    """Straight n x n likelihood on a fine grid with refinement."""
    n, q = x.shape
    s = np.eye(n) - x @ np.linalg.inv(x.T @ x) @ x.T
    lam, u = np.linalg.eigh(s @ (k + np.eye(n)) @ s)
    lam, u = lam[::-1][:n - q] - 1, u[:, ::-1][:, :n - q]
    eta = (u.T @ y) ** 2

    def ll(ld):
        d = math.exp(ld)
        return 0.5 * ((n - q) * (math.log((n - q) / (2 * math.pi)) - 1 - math.log((eta / (lam + d)).sum())) - np.log(lam + d).sum())

    lo, hi = -10.0, 10.0
    for _ in range(8):
        grid = np.linspace(lo, hi, 401)
        best = int(np.argmax([ll(g) for g in grid]))
        lo, hi = grid[max(best - 1, 0)], grid[min(best + 1, 400)]
    return math.exp((lo + hi) / 2), ll((lo + hi) / 2)


def test_reml_low_rank_dense_and_eigen_agree(spark, panel):
    k = panel.z @ panel.z.T / panel.p
    delta, ll = _dense_reml(k, panel.y, np.ones((panel.n, 1)))
    grm = kinship.kinship_additive(panel.geno).cache()
    eig = reml.eigen_summary(grm, panel.pheno)
    for report in (reml.reml(panel.geno, panel.pheno), reml.reml_from_grm(grm, panel.pheno), reml.reml_from_eigen(eig, panel.pheno)):
        r = report.first()
        assert abs(r.delta / delta - 1) < 1e-5 and abs(r.reml_ll - ll) < 1e-7
        assert abs(r.h2 - 1 / (1 + r.delta)) < 1e-12
        assert abs(r.h2_se - math.sqrt(2 / (panel.n * np.var(np.linalg.eigvalsh(k)[1:])))) < 1e-6
    cov = panel.pheno.select("iid", F.lit(0).alias("cov"), F.cos("iid").alias("value"))
    x = np.column_stack([np.ones(panel.n), np.cos(np.arange(panel.n))])
    delta, ll = _dense_reml(k, panel.y, x)
    r = reml.reml_from_grm(grm, panel.pheno, cov).first()
    assert abs(r.delta / delta - 1) < 1e-5 and abs(r.reml_ll - ll) < 1e-7
    tested = reml.likelihood_ratio(reml.reml(panel.geno, panel.pheno)).first()
    null = 0.5 * (-panel.n * (math.log(2 * math.pi) + math.log(panel.n / (panel.n - 1))) - (panel.n - 1))
    assert abs(tested.null_ll - null) < 1e-8 and 0 <= tested.p <= 0.5


def test_golden_values(spark):
    sf = SF.replace("0.001", "0.01")
    kept, _ = qc.qc_markers(fx.geno(spark, sf))
    y = transform.standardise_pheno(fx.pheno(spark, sf))
    r = reml.reml(kept, y).first()
    assert (round(r.delta, 3), round(r.h2, 5), round(r.reml_ll, 4)) == (9.071, 0.09929, -699.4291)
    rows = scan.scan_regions(fx.geno(spark, sf), y, 16, 8).orderBy("block").collect()
    assert [(x.start_idx, x.end_idx) for x in rows] == [(0, 16), (8, 24), (16, 32), (24, 40), (32, 42)]
    assert np.allclose([x.delta for x in rows], [43.80286, 22026.46579, 16.65837, 11.67168, 56.9074], rtol=1e-6)
    assert np.allclose([x.reml_ll for x in rows], [-707.1072, -708.5528, -702.0403, -697.8587, -707.2910], atol=6e-5)
    parts = he.he_regression(kinship.kinship_additive(kept), y, 2)[1].collect()
    assert [round(p.vc, 6) for p in parts] == [0.103785, 0.102791, 0.005387]
    for delta, want in ((1.0, 0.174620), (100.0, 0.174339)):
        z, _ = transform.standardise(kept)
        got = score.r2(score.polygenic_score(z, ridge.ridge(kept, y, delta)).join(y, "iid")).first().r2
        assert abs(got - want) < 1e-6


def test_scan_blocks_match_their_own_reml_with_slices_and_covariates(monkeypatch, spark, panel):
    monkeypatch.setattr(scan, "SCAN_ROWS", 16)
    monkeypatch.setattr(scan, "GROUP_MARKERS", 9)
    monkeypatch.setattr(scan, "FAN_IN", 2)
    cov = panel.pheno.select("iid", F.lit(0).alias("cov"), F.cos("iid").alias("value"))
    report = qc.qc_report(panel.geno, min_observed=-1, min_maf=-1, min_variance=-1)
    for extra, x in ((None, np.ones((panel.n, 1))), (cov, np.column_stack([np.ones(panel.n), np.cos(np.arange(panel.n))]))):
        rows = scan.scan_regions(panel.geno, panel.pheno, 6, 3, covariates=extra, report=report).orderBy("block").collect()
        assert len(rows) == scan.window_count(panel.p, 6, 3)
        for r in rows:
            z = panel.z[:, r.start_idx:r.end_idx]
            delta, ll = _dense_reml(z @ z.T / z.shape[1], panel.y, x)
            assert abs(r.reml_ll - ll) < 1e-6 and abs(math.log(r.delta / delta)) < 1e-3


@pytest.mark.parametrize("p,block,stride", [(42, 16, 8), (10, 10, 5), (11, 10, 5), (7, 10, 5), (100, 10, 3), (13, 4, 6)])
def test_windows_follow_the_walk(spark, p, block, stride):
    want, start = [], 0
    while True:
        end = min(start + block, p)
        want.append((start, end))
        if end >= p:
            break
        start += stride
    markers = spark.range(p).selectExpr("int(id * 5) as marker")
    got = scan.region_windows(markers, block, stride).groupBy("block", "start_idx", "end_idx").agg(
        F.min("idx").alias("a"), F.max("idx").alias("b"), F.count("*").alias("n")).orderBy("block").collect()
    assert [(r.start_idx, r.end_idx) for r in got] == want
    assert all(r.a == r.start_idx and r.b == r.end_idx - 1 and r.n == r.end_idx - r.start_idx for r in got)


def test_scan_failure_falls_back_to_largest_delta():
    known = np.array([[10.0, 0.0], [0.0, 10.0]])
    out = scan._fit_block(np.full((2, 2), np.nan), np.zeros((2, 2)), known, 10.0, 1, np.array([0.1, 0.1]))
    assert out["status"] == "default" and abs(out["delta"] - math.exp(10)) < 1e-9


def test_haseman_elston_equals_dense_regression(spark, panel):
    grm = kinship.kinship_additive(panel.geno).cache()
    dom = kinship.kinship_dominance(panel.geno)
    k, d = square(grm, panel.n), square(dom, panel.n)
    i, j = np.tril_indices(panel.n, -1)
    z = (panel.y[i] - panel.y[j]) ** 2
    cols = [k[i, j], k[i, j] ** 2, d[i, j]]
    models, parts = he.he_regression(grm, panel.pheno, 2, dom)
    parts, models = parts.toPandas(), models.toPandas().set_index("components")
    for size in (1, 2, 3):
        x = np.column_stack([np.ones(len(z)), *cols[:size]])
        beta, se, p, sse = _ols(x, z)
        mine = parts[parts.components == size].sort_values("component")
        assert np.allclose(mine.vc, -beta[1:] / 2, atol=1e-9) and np.allclose(mine.vc_se, se[1:] / 2, atol=1e-9)
        assert np.allclose(mine.p, p[1:] * (size + 1), atol=1e-8)
        n = len(z)
        assert abs(models.bic[size] - (n + n * np.log(2 * np.pi) + n * np.log(sse / n) + np.log(n) * (size + 2))) < 1e-6
    assert list(parts[parts.components == 3].label) == ["additive", "epistasis 2-way", "dominance"]
    residual = he.he_regression(grm, panel.pheno, 2, dom, residual=True)[1].toPandas()
    done = [np.ones(len(z))]
    for c in cols:
        base = np.column_stack(done)
        done.append(c if len(done) == 1 else c - base @ np.linalg.lstsq(base, c, rcond=None)[0])
    beta, *_ = _ols(np.column_stack(done), z)
    assert np.allclose(residual[residual.components == 3].sort_values("component").vc, -beta[1:] / 2, atol=1e-8)


def test_ridge_ways_agree(spark, panel):
    delta = 7.0
    want = np.linalg.solve(panel.z.T @ panel.z + delta * np.eye(panel.p), panel.z.T @ panel.y)
    assert np.abs(by_marker(ridge.ridge(panel.geno, panel.pheno, delta)) - want).max() < 1e-9
    assert np.abs(by_marker(ridge.ridge_dual(panel.geno, panel.pheno, delta)) - want).max() < 1e-9
    cg = ridge.ridge_cg(panel.geno, panel.pheno, delta, 1e-3, 20, rows=16, cols=8)
    assert np.abs(by_marker(cg) - want).max() < 1e-2 * np.abs(want).max()
    prior = np.linspace(0, 1, panel.p)
    table = spark.createDataFrame(pd.DataFrame({"marker": np.arange(panel.p), "beta": prior}), "marker int, beta double")
    w, d = np.diag(prior ** 2 / 0.7), 0.7 / 0.3
    hetero = w @ panel.z.T @ np.linalg.solve(panel.z @ w @ panel.z.T + d * np.eye(panel.n), panel.y)
    assert np.abs(by_marker(ridge.ridge_hetero(panel.geno, panel.pheno, table, 0.3, "direct")) - hetero).max() < 1e-9
    wi = 1.0 + np.arange(panel.n) % 4
    weights = spark.createDataFrame(pd.DataFrame({"iid": np.arange(panel.n), "w": wi}), "iid long, w double")
    for flag, right in ((True, panel.z.T @ (wi * panel.y)), (False, panel.z.T @ panel.y)):
        obs = np.linalg.solve((panel.z * wi[:, None]).T @ panel.z + 2 * np.eye(panel.p), right)
        got = by_marker(ridge.ridge_observation_weighted(panel.geno, panel.pheno, weights, 2.0, flag))
        assert np.abs(got - obs).max() < 1e-9
    assert np.abs(by_marker(ridge.fit_effects(panel.geno, panel.pheno, -1))
                  - _ols(np.column_stack([np.ones(panel.n), panel.z]), panel.y)[0][1:]).max() < 1e-8


def test_driver_bounds_are_errors_of_the_direct_ways_only(monkeypatch, panel):
    monkeypatch.setattr(ridge, "MAX_DRIVER_SIDE", 10)
    with pytest.raises(ValueError, match="driver"):
        ridge.ridge(panel.geno, panel.pheno, 1.0)
    # the default has no bound and gives the same effects at every size
    exact = by_marker(ridge.fit_effects(panel.geno, panel.pheno, 1.0))
    monkeypatch.setattr(ridge, "MAX_DRIVER_SIDE", 4096)
    for method in ("markers", "individuals"):
        assert np.abs(by_marker(ridge.fit_effects(panel.geno, panel.pheno, 1.0, method)) - exact).max() < 1e-7


def test_ways_agree_when_phenotypes_are_missing(panel):
    some = panel.pheno.filter("iid % 3 <> 0")
    rows = np.arange(panel.n) % 3 != 0
    m, y = panel.m[rows], panel.y[rows]
    z = (m - m.mean(0)) / np.where(m.std(0) == 0, 1, m.std(0))
    want = np.linalg.solve(z.T @ z + 2 * np.eye(panel.p), z.T @ (y - y.mean()))
    for way in (ridge.ridge, ridge.ridge_dual, ridge.ridge_cg):
        assert np.abs(by_marker(way(panel.geno, some, 2.0)) - want).max() < 1e-7, way.__name__


def test_scan_with_covariates_leaves_out_incomplete_people(spark, panel):
    """Covariates in several aggregates, absent ones, and a likelihood ratio against the fixed effects alone."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((panel.n, 5))
    table = pd.DataFrame([(i, c, x[i, c]) for i in range(panel.n) for c in range(5) if not (i in (4, 9) and c == i % 5)], columns=["iid", "cov", "value"])
    cov = spark.createDataFrame(table, "iid long, cov int, value double")
    complete = [i for i in range(panel.n) if i not in (4, 9)]
    first = scan.scan_regions(panel.geno, panel.pheno, 8, 8, covariates=cov).toPandas().set_index("block")
    keep = [i for i in complete]
    small = panel.geno.filter(~panel.geno.iid.isin(4, 9))
    again = scan.scan_regions(panel.geno, panel.pheno.filter("iid not in (4, 9)"), 8, 8, covariates=cov.filter("iid not in (4, 9)")).toPandas().set_index("block")
    assert np.allclose(first.reml_ll, again.reml_ll) and (first.n == len(keep)).all() and (first.n_fixed == 6).all()
    small_tiles = tiles.tile_table(panel.geno, "iid", "marker", "dosage", 16, 4)  # blocks lie across tiles
    chunked = scan.scan_tiles(small_tiles, panel.pheno, 8, 8, cov, rows=16, cols=4).toPandas().set_index("block")
    assert np.allclose(first.delta, chunked.delta)
    design = np.column_stack([np.ones(len(keep)), x[keep]])
    res = panel.y[keep] - design @ np.linalg.lstsq(design, panel.y[keep], rcond=None)[0]
    sse, n = float(res @ res), len(keep)
    null = 0.5 * (-n * (np.log(2 * np.pi) + np.log(sse / (n - 6))) - (n - 6))
    tested = reml.likelihood_ratio(spark.createDataFrame(first.reset_index()[["n", "y_ss", "n_fixed", "reml_ll"]])).first()
    assert abs(tested.null_ll - null) < 1e-8 and small.count() > 0


def test_ridge_blup_job_predicts_held_out(panel):
    out, effects = jobs.ridge_blup(panel.geno.filter("iid >= 12"), panel.pheno.filter("iid >= 12"), panel.geno.filter("iid < 12"), 0.5, method="markers")
    assert out.count() == 12 and effects.count() > 0
    tr = panel.m[12:]
    got = effects.toPandas().sort_values("marker")
    z = ((tr - tr.mean(0)) / tr.std(0))[:, got.marker]
    y = panel.y[12:]
    y = (y - y.mean()) / y.std()
    want = np.linalg.solve(z.T @ z + np.eye(z.shape[1]), z.T @ y)
    assert np.abs(got.beta - want).max() < 1e-9
    v = panel.m[:12][:, got.marker]
    sd = v.std(0)
    zv = (v - v.mean(0)) / np.where(sd == 0, 1, sd)
    pred = out.toPandas().sort_values("iid").yhat
    assert np.abs(pred - zv @ want).max() < 1e-8


def test_results_do_not_depend_on_partitions_or_order(spark, panel):
    a = by_marker(ridge.ridge(panel.geno, panel.pheno, 3.0))
    b = by_marker(ridge.ridge(panel.geno.orderBy(F.rand(1)).repartition(11), panel.pheno.repartition(3), 3.0))
    assert np.abs(a - b).max() < 1e-12


def test_lanczos_quadrature_is_exact_for_full_steps_and_close_with_random_probes(spark, panel):
    exact = reml.reml(panel.geno, panel.pheno).first()
    run = reml.reml_lanczos(panel.geno, panel.pheno, steps=12, probes=60, rows=32, cols=8).first()
    assert run.side.startswith("lanczos") and abs(run.y_ss - exact.y_ss) < 1e-9
    assert abs(run.h2 - exact.h2) < 0.1 and abs(run.vg + run.ve - exact.vg - exact.ve) < 0.1
    stored = reml.reml_lanczos_from_grm(kinship.kinship_additive(panel.geno), panel.pheno, steps=12, probes=60).first()
    assert abs(stored.h2 - run.h2) < 1e-6
    # The part that starts at y has no randomness: its quadrature gives the quadratic form itself.
    k = panel.z @ panel.z.T / panel.p
    spec_values, spec_vectors = np.linalg.eigh(k)
    y = panel.y - panel.y.mean()
    alphas, betas, q, old, beta = [], [], y / np.linalg.norm(y), 0.0, 0.0
    for _ in range(30):
        w = k @ q
        a = q @ w
        alphas.append([a, a])
        w = w - a * q - beta * old
        beta, old = np.linalg.norm(w), q
        if beta < 1e-9:
            break
        betas.append([beta, beta])
        q = w / beta
    spec = reml._quadrature(np.array(alphas), np.array(betas)[:len(alphas) - 1].reshape(-1, 2), np.array([y @ y, y @ y]), panel.n)
    for ld in (-2.0, 0.0, 3.0):
        want = ((spec_vectors.T @ y) ** 2 / (spec_values + math.exp(ld))).sum()
        assert abs(spec.sums(ld)[0][0] / want - 1) < 1e-6


def he_sums_by_pairs(matrices, y, epi):
    """Products of (1, x.., z) over all pairs, from square matrices on the driver."""
    at = np.tril_indices(len(y), -1)
    x = [matrices[0][at] ** k for k in range(1, epi + 1)] + [m[at] for m in matrices[1:]]
    design = np.stack([np.ones(len(at[0])), *x, (y[at[0]] - y[at[1]]) ** 2])
    return (design @ design.T)[np.triu_indices(len(design))]


def sums_of(table, k):
    labels = ["1", *(f"x{c}" for c in range(1, k + 1)), "z"]
    found = {(r.a, r.b): r.s for r in table.collect()}
    return np.array([found[labels[a], labels[b]] for a, b in zip(*np.triu_indices(len(labels)))])


def test_he_sums_without_pairs(spark, panel):
    rng = np.random.default_rng(8)
    cov = rng.standard_normal((panel.n, 2))
    covariates = spark.createDataFrame([(i, c, float(cov[i, c])) for i in range(panel.n) for c in range(2)], "iid long, cov int, value double")
    zc = (cov - cov.mean(0)) / cov.std(0)
    dom = np.minimum(panel.raw, 1).clip(0)
    zd = (dom - dom.mean(0)) / np.where(dom.std(0) == 0, 1, dom.std(0))
    k, d, c = panel.z @ panel.z.T / panel.p, zd @ zd.T / panel.p, zc @ zc.T / 2
    want = he_sums_by_pairs([k], panel.y, 3)
    assert np.allclose(sums_of(he.cross_products_from_genotypes(panel.geno, panel.pheno, 3), 3), want)
    for form in ("tiles", "pairs"):
        assert np.allclose(sums_of(he.cross_products(kinship.kinship_additive(panel.geno, form=form), panel.pheno, 3), 3), want)
    want = he_sums_by_pairs([k, d, c], panel.y, 2)
    assert np.allclose(sums_of(he.cross_products_from_genotypes(panel.geno, panel.pheno, 2, True, covariates), 4), want)
    stored = [kinship.kinship_dominance(panel.geno, form="tiles"), kinship.covariate_kinship(covariates)]
    assert np.allclose(sums_of(he.cross_products(kinship.kinship_additive(panel.geno, form="tiles"), panel.pheno, 2, stored), 4), want)
    a = he.he_regression(kinship.kinship_additive(panel.geno), panel.pheno, 2, stored[0])[1].toPandas()
    b = he.he_regression_from_genotypes(panel.geno, panel.pheno, 2, dominance=True)[1].toPandas()
    assert np.allclose(a.vc, b.vc) and np.allclose(a.p, b.p)


def dense_reml(k, y, x):
    return reml.maximise(reml.spectrum_from_kinship(k, y, x))


def test_reml_with_fixed_effects_by_every_way(spark, panel):
    """Two covariates, one that follows from another, people without y or a covariate: dense matrices, markers, tiles, and full Lanczos steps."""
    rng = np.random.default_rng(4)
    c = rng.standard_normal((panel.n, 2))
    rows = [(i, k, float(v)) for i in range(panel.n) for k, v in enumerate([c[i, 0], c[i, 1] if i % 13 else None, 2 * c[i, 0] + 1]) if v is not None]
    covariates = spark.createDataFrame(rows, "iid long, cov int, value double")
    two = covariates.where("cov < 2")
    pheno = panel.pheno.selectExpr("iid", "if(iid % 6 = 0, null, y) as y")
    ids = np.array([i for i in range(panel.n) if i % 6 and i % 13])
    z = panel.m[ids]
    z = (z - z.mean(0)) / np.where(z.std(0) == 0, 1, z.std(0))
    y, x, k = panel.y[ids], np.column_stack([np.ones(len(ids)), c[ids]]), z @ z.T / panel.p
    want = dense_reml(k, y, x)
    for method in ("markers", "individuals"):
        got = reml.reml(panel.geno, pheno, method, two).first()
        assert abs(got.h2 - want["h2"]) < 1e-6 and abs(got.reml_ll - want["reml_ll"]) < 1e-6 and got.n_fixed == 3 and got.n == len(ids)
    # unit vectors in place of random signs make the traces exact, and full steps the spectrum
    few = ids[:20]
    z = panel.m[few]
    z = (z - z.mean(0)) / np.where(z.std(0) == 0, 1, z.std(0))
    y, x, k = panel.y[few], np.column_stack([np.ones(len(few)), c[few]]), z @ z.T / panel.p
    want = dense_reml(k, y, x)
    people = reml.fit_people(panel.geno, panel.pheno.where(F.col("iid").isin(few.tolist())), covariates)
    design, rank = reml.orthonormal_design(*reml.fixed_effects(people, covariates), grm_tiles.TILE_COLS)
    assert rank == 3 and people.count() == len(few)
    w = np.zeros((grm_tiles.TILE_COLS, len(few) + 1))
    w[few, 0], w[few, 1 + np.arange(len(few))] = y, 1.0
    start = spark.createDataFrame([(0, w.ravel().tolist())], "block int, w array<double>")
    tiles = kinship.kinship_additive(panel.geno.where(F.col("iid").isin(few.tolist())), form="tiles").cache()
    spec, y_ss = reml.lanczos_spectrum(lambda v: grm_tiles.times(tiles, v, len(few) + 1), start, design, rank, len(few), len(few) + 1, 99)
    got = reml.maximise(spec)
    assert abs(spec.df - (len(few) - 3)) < 1e-8 and all(abs(got[q] - want[q]) < 1e-6 * max(1, abs(want[q])) for q in ("h2", "reml_ll", "eigen_var", "vg"))
    residual = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    assert abs(y_ss - residual @ residual) < 1e-9


def test_lanczos_without_some_phenotypes(spark, panel):
    pheno = panel.pheno.selectExpr("iid", "if(iid % 3 = 0, null, y) as y")
    exact = reml.reml(panel.geno, pheno, "individuals").first()
    runs = [reml.reml_lanczos(panel.geno, pheno, steps=10, probes=40, rows=32, cols=8).first(),
            reml.reml_lanczos_from_grm(kinship.kinship_additive(panel.geno.where("iid % 3 <> 0"), form="tiles"), pheno, steps=10, probes=40).first()]
    for r in runs:
        assert r.n == exact.n and abs(r.y_ss - exact.y_ss) < 1e-9 and abs(r.h2 - exact.h2) < 0.15
    assert abs(runs[0].h2 - runs[1].h2) < 1e-6
    eig = reml.eigen_summary(kinship.kinship_additive(panel.geno), panel.pheno)
    with pytest.raises(ValueError, match="taken anew"):
        reml.reml_from_eigen(eig, pheno)


def test_he_sums_of_sparse_genotypes(spark, panel):
    """Some have no cell of a marker, some no phenotype, some no covariate: all sums run over the others."""
    geno = panel.geno.filter("(iid + marker) % 3 <> 0 and iid <> 4")
    pheno = panel.pheno.selectExpr("iid", "if(iid % 7 = 5, null, y) as y")
    covariates = spark.createDataFrame([(i, 0, float(i % 11) if i % 13 else None) for i in range(panel.n)], "iid long, cov int, value double")
    ids = np.array([i for i in range(panel.n) if i % 7 != 5 and i != 4 and i % 13])
    z = np.zeros((len(ids), panel.p))
    for j in range(panel.p):
        have = (ids + j) % 3 != 0
        x = panel.m[ids[have], j]
        z[have, j] = (x - x.mean()) / (x.std() or 1)
    c = ids % 11
    zc = (c - c.mean()) / c.std()
    want = he_sums_by_pairs([z @ z.T / panel.p, np.outer(zc, zc)], panel.y[ids], 2)
    assert np.allclose(sums_of(he.cross_products_from_genotypes(geno, pheno, 2, covariates=covariates), 3), want)


def test_people_without_phenotype_take_no_part(spark, panel):
    pheno = panel.pheno.selectExpr("iid", "if(iid % 3 = 0, null, y) as y")
    ids = np.arange(panel.n)[np.arange(panel.n) % 3 != 0]
    x, y = panel.m[ids], panel.y[ids]
    got = {r.marker: r for r in regression.uni_reg(panel.geno, pheno).collect()}
    for j in range(panel.p):
        design = np.stack([np.ones(len(ids)), x[:, j]], axis=1)
        assert abs(got[j].beta - np.linalg.lstsq(design, y, rcond=None)[0][1]) < 1e-9 and got[j].df == len(ids) - 2
    cells = panel.geno.selectExpr("iid", "marker as term", "double(greatest(dosage, 0)) as value").where("term < 5")
    design = np.column_stack([np.ones(len(ids)), x[:, :5]])
    want = np.linalg.lstsq(design, y, rcond=None)[0]
    fit = {r.term: r for r in regression.multi_reg(cells, pheno).collect()}
    assert np.allclose([fit[t].beta for t in range(-1, 5)], want) and fit[0].df == len(ids) - 6
    res = regression.squared_residuals(cells, pheno, regression.multi_reg(cells, pheno))
    assert res.where("res is null").count() == 0
    k = square(kinship.kinship_additive(panel.geno), panel.n)[np.ix_(ids, ids)]
    stored = he.he_regression(kinship.kinship_additive(panel.geno, form="tiles"), pheno, 1)[1].where("components = 1").first()
    at = np.tril_indices(len(ids), -1)
    slope = np.polyfit(k[at], (y[at[0]] - y[at[1]]) ** 2, 1)[0]
    assert abs(stored.vc + slope / 2) < 1e-9


def test_scaled_gradients_and_non_convergence(spark, panel):
    d = np.where(np.arange(panel.p) % 4 == 0, 0.0, 0.5 + np.arange(panel.p) / 10)
    scales = spark.createDataFrame(pd.DataFrame({"marker": np.arange(panel.p), "d": d}), "marker int, d double")
    want = by_marker(ridge.ridge_scaled(panel.geno, panel.pheno, scales, 400.0, "direct"))
    got = by_marker(ridge.ridge_cg(panel.geno, panel.pheno, 400.0, 1e-7, 12, rows=32, cols=8, scales=scales))
    assert np.abs(got - want).max() < 1e-5 * np.abs(want).max() and (got[::4] == 0).all()
    with pytest.raises(ValueError, match="convergence"):
        ridge.ridge_cg(panel.geno, panel.pheno, 0.01, 1e-12, 2)


def test_association_from_tiles(spark, panel):
    """Several traits with different people each, cells that aren't there, tiles of a few rows and columns."""
    geno = panel.geno.filter("(iid + marker) % 5 <> 0")
    pheno = panel.pheno.selectExpr("iid", "explode(map('a', if(iid % 4 = 0, null, y), 'b', iid * y)) as (trait, y)")
    table = tiles.tile_table(geno, "iid", "marker", "dosage", 16, 8)
    names = ["trait", "marker", "n", "sx", "sy", "sxx", "sxy", "syy"]
    got = regression.association_sums_from_tiles(table, pheno, 16, 8).select(names).toPandas().sort_values(names[:2]).reset_index(drop=True)
    want = pd.concat([regression.association_sums(geno, pheno.where(F.col("trait") == t)).toPandas().assign(trait=t) for t in "ab"])
    pd.testing.assert_frame_equal(got, want[names].sort_values(names[:2]).reset_index(drop=True), check_dtype=False)
    whole = tiles.tile_table(panel.geno, "iid", "marker", "dosage")
    one = regression.uni_reg_tiles(whole, panel.pheno).toPandas().sort_values("marker")
    assert np.allclose(one.p, regression.uni_reg(panel.geno, panel.pheno).toPandas().sort_values("marker").p)


def test_blocked_factors_solve_like_the_dense_system(monkeypatch, spark, panel):
    """Blocks of 8 on 24 terms, with the driver's bound at 8: the same coefficients, errors and p-values; the same weighted ridge."""
    cells = _cells(panel).withColumn("term", F.col("term") * 3 + 1)
    pheno = panel.pheno.selectExpr("iid", "if(iid % 9 = 0, null, y) as y")
    weights = panel.pheno.selectExpr("iid", "1 + iid % 3 as w")
    def both():
        fit = regression.multi_reg(cells, pheno).toPandas().sort_values("term")
        weighted = [by_marker(ridge.ridge_observation_weighted(panel.geno, panel.pheno, weights, 3.0, w)) for w in (True, False)]
        return fit, weighted
    want, want_weighted = both()
    monkeypatch.setattr(regression, "MAX_DRIVER_SIDE", 8)
    monkeypatch.setattr(ridge, "MAX_DRIVER_SIDE", 8)
    monkeypatch.setattr(cholesky, "SIDE", 8)
    monkeypatch.setattr(cholesky.solve, "__defaults__", (0.0, 8))
    got, got_weighted = both()
    assert list(got.term) == list(want.term) and all(np.allclose(got[c], want[c], rtol=1e-8) for c in ("beta", "se", "t", "p", "df", "sse", "mse"))
    assert all(np.allclose(a, b) for a, b in zip(got_weighted, want_weighted))
    collinear = cells.unionByName(cells.where("term = 1").withColumn("term", F.lit(500)))
    with pytest.raises(np.linalg.LinAlgError):
        regression.multi_reg(collinear, pheno)
