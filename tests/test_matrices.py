import numpy as np
import pandas as pd
import pytest
from conftest import square
from pyspark.sql import functions as F

from locusframe.operators import grm_tiles, kinship, qc, tiles, transform


def test_qc_order_and_disabled_checks(spark):
    cells = {0: [-1] * 2 + [2] * 18, 1: [0] * 20, 2: [2] * 20, 3: [0, 1] * 10, 4: [-1, 1] + [0, 2] * 9}
    rows = [(i, m, d) for m, v in cells.items() for i, d in enumerate(v)]
    geno = spark.createDataFrame(rows, "iid long, marker int, dosage int")
    reason = {r.marker: r.reason for r in qc.qc_report(geno).collect()}
    # 1 of 20 missing is 0.05, just below the double 1 - 0.95.
    assert reason == {0: "missing", 1: "maf", 2: "variance", 3: None, 4: None}
    off = {r.marker: r.reason for r in qc.qc_report(geno, min_observed=-1, min_maf=-1).collect()}
    assert off == {0: None, 1: "variance", 2: "variance", 3: None, 4: None}
    kept, _ = qc.qc_markers(geno, min_observed=-1)
    assert kept.filter("dosage < 0").count() == 0
    assert kept.select("marker").distinct().count() == 3


def test_standardise_matches_numpy_and_strict_fails(spark, panel):
    z, params = transform.standardise(panel.geno)
    pdf = z.toPandas()
    assert np.abs(pdf.z - panel.z[pdf.iid, pdf.marker]).max() < 1e-12
    flat = panel.geno.selectExpr("iid", "marker", "if(marker = 3, 1, dosage) as dosage")
    assert transform.standardise(flat)[0].filter("marker = 3 and z <> 0").count() == 0
    with pytest.raises(Exception, match="monomorphic"):
        transform.standardise_strict(flat).count()


@pytest.mark.parametrize("rows,cols", [(512, 1024), (16, 8), (64, 5), (2, 8), (2, 64), (1, 3)])
def test_gram_is_the_same_for_every_blocking(monkeypatch, panel, rows, cols):
    monkeypatch.setattr(tiles, "STRIPE", 16)
    monkeypatch.setattr(tiles, "FRAGMENT_CELLS", 50)
    params = transform.scale_params(panel.geno)
    got = square(tiles.gram(panel.geno, "iid", "marker", "dosage", params, rows=rows, cols=cols), panel.n, "s")
    assert np.abs(got - panel.z @ panel.z.T).max() < 1e-10
    raw = square(tiles.gram(panel.geno, "marker", "iid", "dosage", rows=rows, cols=cols), panel.p, "s")
    assert (raw == panel.m.T @ panel.m).all()
    far = square(tiles.gram(panel.geno, "iid", "marker", "dosage", rows=rows, cols=cols, distance=True), panel.n, "s")
    assert (far == ((panel.m[:, None] - panel.m[None]) ** 2).sum(-1)).all()


def test_gram_leaves_absent_rows_out(spark):
    cells = spark.createDataFrame([(0, 0, 1), (700, 0, 2), (700, 3, 1)], "r int, c int, v int")
    got = {(x.i, x.j): x.s for x in tiles.gram(cells, "r", "c", "v").collect()}
    assert got == {(0, 0): 1.0, (700, 0): 2.0, (700, 700): 5.0}


def test_distance_gaussian_dominance_covariates(spark, panel):
    d = square(kinship.euclidean_distance(panel.geno), panel.n, "d")
    want = np.sqrt(((panel.m[:, None] - panel.m[None]) ** 2).sum(-1))
    assert np.abs(d - want).max() < 1e-9
    g = square(kinship.kinship_gaussian(panel.geno, theta=0.7), panel.n)
    dz = np.sqrt(((panel.z[:, None] - panel.z[None]) ** 2).sum(-1)) / 2 / np.sqrt(panel.p)
    assert np.abs(g - np.exp(-(dz / 0.7) ** 2)).max() < 1e-9
    dom = np.where(panel.m == 2, 1, panel.m)
    dom = (dom - dom.mean(0)) / dom.std(0)
    assert np.abs(square(kinship.kinship_dominance(panel.geno), panel.n) - dom @ dom.T / panel.p).max() < 1e-10


def test_weights_cancel_before_scaling_and_merge_is_the_whole(spark, panel):
    w = spark.createDataFrame(pd.DataFrame({"marker": np.arange(panel.p), "w": 1.0 + np.arange(panel.p)}), "marker int, w double")
    k = panel.z @ panel.z.T / panel.p
    assert np.abs(square(kinship.kinship_weighted(panel.geno, w, mode="reference"), panel.n) - k).max() < 1e-10
    ww = 1.0 + np.arange(panel.p)
    post = (panel.z * ww) @ panel.z.T / ww.sum()
    assert np.abs(square(kinship.kinship_weighted(panel.geno, w), panel.n) - post).max() < 1e-10
    parts = [kinship.kinship_additive(panel.geno.filter(c)) for c in ("marker < 9", "marker >= 9")]
    assert np.abs(square(kinship.merge_kinships(parts), panel.n) - k).max() < 1e-10
    lost = parts[1].filter("i <> 5 and j <> 5")
    assert kinship.merge_kinships([parts[0], lost]).filter("i = 5 or j = 5").count() == 0
    t = kinship.trace_stats(kinship.kinship_additive(panel.geno)).first()
    assert abs(t.sum_sq - (k ** 2).sum()) < 1e-8 and abs(t.trace - np.trace(k)) < 1e-9


def test_tile_tables_hold_the_same_matrices(spark, panel):
    """Tiles to pairs and back, powers, kernels, merges with missing individuals, traces: against dense matrices."""
    k = panel.z @ panel.z.T / panel.p
    tiles = kinship.kinship_additive(panel.geno, form="tiles")
    assert np.allclose(square(grm_tiles.pairs(tiles), panel.n), k)
    shifted = grm_tiles.pairs(tiles).selectExpr("i + 480 as i", "j + 480 as j", "k", "n_snps")  # over a border of tiles
    back = grm_tiles.from_pairs(shifted)
    assert back.count() > 1 and np.allclose(square(grm_tiles.pairs(back).selectExpr("i - 480 as i", "j - 480 as j", "k"), panel.n), k)
    assert sorted(r.iid for r in grm_tiles.individuals(back).collect()) == list(range(480, 480 + panel.n))
    assert np.allclose(square(grm_tiles.pairs(kinship.epistasis(tiles, 3)), panel.n), k**3)
    halves = [kinship.kinship_additive(panel.geno.filter(c), form="tiles") for c in ("marker < 9", "marker >= 9")]
    merged = grm_tiles.pairs(kinship.merge_kinships(halves))
    assert np.allclose(square(merged, panel.n), k) and merged.where(f"n_snps <> {panel.p}").count() == 0
    few = kinship.kinship_additive(panel.geno.filter("marker >= 9 and iid <> 5"), form="tiles")
    assert grm_tiles.pairs(kinship.merge_kinships([halves[0], few])).where("i = 5 or j = 5").count() == 0
    counted = grm_tiles.pairs(tiles).withColumn("n_snps", 1.0 + (F.col("i") + F.col("j")) % 3)  # a count per pair
    assert grm_tiles.pairs(grm_tiles.from_pairs(counted)).exceptAll(counted).count() == 0
    t, dense = kinship.trace_stats(back).first(), (k**2).sum()
    assert t.n == panel.n and abs(t.trace - np.trace(k)) < 1e-9 and abs(t.sum_sq - dense) < 1e-8
    d2 = ((panel.z[:, None] - panel.z[None]) ** 2).sum(-1)
    assert np.allclose(square(grm_tiles.pairs(kinship.kinship_gaussian(panel.geno, form="tiles")), panel.n), np.exp(-d2 / panel.p))
    none = panel.geno.where("false")
    assert kinship.kinship_additive(none, form="tiles").count() == 0


def test_tiles_are_as_wide_as_their_columns(spark, panel, monkeypatch):
    """before, two covariates of 512 people took a tile of 4 MB, so that a task which read a few dozens of them ran out of memory."""
    seen, product = [], tiles.row_gram

    def spy(table, rows, cols, **options):
        seen.append((cols, table.selectExpr("max(length(x))").first()[0]))
        return product(table, rows, cols, **options)

    monkeypatch.setattr(tiles, "row_gram", spy)
    two = panel.geno.where("marker < 2").selectExpr("iid", "marker as cov", "double(greatest(dosage, 0)) as value")
    assert np.allclose(square(kinship.covariate_kinship(two), panel.n), panel.z[:, :2] @ panel.z[:, :2].T / 2)
    far = panel.geno.selectExpr("iid", "marker + 1010 as marker", "dosage")  # over a border of tiles
    for geno in (panel.geno, far):
        assert np.allclose(square(kinship.kinship_additive(geno), panel.n), panel.z @ panel.z.T / panel.p)
    assert seen == [(2, 512 * 2 * 8), (32, 512 * 32), (1024, 512 * 1024)]


def test_rows_of_large_blocks_come_by_value_where_that_is_smaller(spark, panel, monkeypatch):
    """Before, each of n (n + 1) / 2 rounded values took its eight bytes, as no two equal ones were neighbours."""
    from conftest import Panel

    large = Panel(spark, n=1600, missing=0.0)
    k = large.z @ large.z.T / large.p
    monkeypatch.setattr(tiles, "DICTIONARY", 64)

    def runs(table, want):
        got = table.toPandas()
        assert len(got) == large.n * (large.n + 1) // 2 and not got.duplicated(["i", "j"]).any() and (got.j <= got.i).all()
        assert np.abs(got.k - want[got.i, got.j]).max() < 1e-12 and (got.n_snps == large.p).all()
        return (np.diff(got.k.round(2)) != 0).sum()

    as_is, by_value, all_differ = (runs(kinship.kinship_additive(large.geno, digits=d), k) for d in (None, 2, 12))
    assert by_value < as_is / 4 and all_differ > as_is / 2
    cubes = kinship.epistasis(kinship.kinship_additive(large.geno, form="tiles"), 3)
    assert runs(grm_tiles.pairs(cubes, 2), k**3) < runs(grm_tiles.pairs(cubes), k**3) / 4
    counted = kinship.kinship_additive(panel.geno).withColumn("n_snps", 1.0 + (F.col("i") + F.col("j")) % 3)  # a count per pair
    assert grm_tiles.pairs(grm_tiles.from_pairs(counted), 2).exceptAll(counted).count() == 0


def test_products_take_only_columns_with_statistics():
    """Before, a block of few markers was multiplied as if it had all columns of a tile."""
    rng = np.random.default_rng(1)
    raw = np.full((tiles.ROWS, tiles.COLS), tiles.ABSENT, np.int8)
    raw[:100, :7] = rng.integers(-1, 3, (100, 7))
    mu, inv = np.zeros(tiles.COLS), np.zeros(tiles.COLS)
    mu[:5], inv[:5] = rng.random(5), 1 + rng.random(5)
    blobs = raw.tobytes(), mu.tobytes(), inv.tobytes()
    whole, rows, cols = tiles.decode(*blobs, tiles.ROWS, tiles.COLS)
    few, *present = tiles.decode(*blobs, tiles.ROWS, tiles.COLS, narrow=True)
    assert few.shape == (tiles.ROWS, 5) and (few == whole[:, :5]).all() and not whole[:, 5:].any()
    assert (present[0] == rows).all() and (present[1] == cols).all()
    product = tiles._PairProduct(0, 0, 1, tiles.ROWS, tiles.COLS)
    product.take(0, 0, 0, *blobs)
    assert next(iter(product.tiles.values())).shape[1] == 5


def test_long_blocks_come_in_runs_of_columns():
    """before, a row of a block went over thousands of columns, whose repeats were too far apart for a table's compression."""
    i, j = np.arange(5000, 5003), np.arange(0, 4096)
    block = np.arange(3 * 4096).reshape(3, 4096)
    at_i, at_j, values = tiles.lower_pairs(i, j, block)
    assert (np.diff(at_j) < 0).sum() == 3 * 4096 // tiles.ROWS - 4096 // tiles.ROWS
    assert sorted(zip(at_i, at_j)) == [(a, b) for a in i for b in j] and (values == block[at_i - 5000, at_j]).all()


def test_lower_pairs():
    for i, j in ((np.arange(5, 8), np.arange(3, 9)), (np.arange(5, 8), np.arange(0, 6)), (np.arange(5, 8), np.arange(0)), (np.arange(3), np.arange(4, 6))):
        block = np.random.default_rng(3).random((len(i), len(j)))
        got = list(zip(*(x.tolist() for x in tiles.lower_pairs(i, j, block))))
        assert got == [(a, b, block[x, y]) for x, a in enumerate(i.tolist()) for y, b in enumerate(j.tolist()) if b <= a]
