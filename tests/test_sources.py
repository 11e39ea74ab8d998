import os
import struct

import numpy as np
import pandas as pd
import pytest
from conftest import square
from pyspark.sql import functions as F

from locusframe.operators import kinship, qc, reml, ridge, score, transform
from locusframe.operators.tiles import tile_table
from locusframe.plans import jobs
from locusframe.session import materialise
from locusframe.sources import grm, plink, sinks, text


def _write_bed(path, raw):
    """A tiny independent writer for the format."""
    code = {2: 0, -1: 1, 1: 2, 0: 3}
    with open(path, "wb") as f:
        f.write(bytes([108, 27, 1]))
        for column in raw.T:
            for at in range(0, len(column), 4):
                byte = 0
                for k, d in enumerate(column[at:at + 4]):
                    byte |= code[int(d)] << (2 * k)
                f.write(bytes([byte]))


@pytest.fixture(scope="module")
def files(tmp_path_factory, panel):
    prefix = str(tmp_path_factory.mktemp("plink") / "set")
    _write_bed(prefix + ".bed", panel.raw)
    names = ["." if m % 3 == 0 else f"rs{m}" for m in range(panel.p)]
    with open(prefix + ".bim", "w") as f:
        f.writelines(f"1 {names[m]}\t0 {m * 10} A G\n" for m in range(panel.p))
    with open(prefix + ".fam", "w") as f:
        f.writelines(f"F{i} I{i} 0 0 1 {1 + i % 2}\n" for i in range(panel.n))
    with open(prefix + ".pheno", "w") as f:
        f.writelines(f"F{i}\tI{i}\t{panel.y[i]:.6f}\n" for i in range(panel.n - 1, -1, -1))
    return prefix


def _matrix(geno, n, p):
    pdf = geno.toPandas()
    assert len(pdf) == n * p
    out = np.full((n, p), -9)
    out[pdf.iid, pdf.marker] = pdf.dosage
    return out


def test_read_bed_partitions_and_filters(spark, panel, files, monkeypatch):
    geno, markers, samples = plink.read_plink(spark, files)
    assert (_matrix(geno, panel.n, panel.p) == panel.raw).all()
    monkeypatch.setattr(plink, "READ_CELLS", 40)
    assert (_matrix(plink.read_bed(spark, files + ".bed", panel.n), panel.n, panel.p) == panel.raw).all()
    bed = plink.read_bed(spark, files + ".bed", panel.n)
    for cond, want in (("marker in (3, 7, 99)", [3, 7]), ("marker >= 5 and marker < 7", [5, 6]), ("marker = 4", [4]), ("marker > 400", [])):
        assert sorted(r.marker for r in bed.filter(cond).select("marker").distinct().collect()) == want
    reader = plink.BedReader({"path": files + ".bed", "samples": str(panel.n)})
    assert list(reader.pushFilters([plink.EqualTo(("marker",), 4)])) == []
    assert {p.first for p in reader.partitions()} == {4}
    named = {r.marker: r.rsid for r in markers.collect()}
    assert named[0] == ".:dup1" and named[3] == ".:dup2" and named[1] == "rs1"
    assert plink.duplicated_markers(markers).count() == len(range(0, panel.p, 3))
    letters = {r.genotype for r in plink.allele_letters(geno, markers).select("genotype").distinct().collect()}
    assert letters == {"AA", "AG", "GG", "00"}
    with pytest.raises(Exception, match="marker not found"):
        plink.read_marker_subset(geno, markers, spark.createDataFrame([("nope",)], "rsid string")).count()
    assert samples.filter("status = 2").count() == panel.n // 2


@pytest.mark.parametrize("rows,cols,layout", [(512, 1024, "file"), (8, 5, "file"), (16, 8, "parts")])
def test_tiles_straight_from_the_file(spark, panel, files, tmp_path, monkeypatch, rows, cols, layout):
    monkeypatch.setattr(plink, "TILE_BYTES", 40)
    path = files + ".bed"
    if layout == "parts":
        path = str(tmp_path / "parts.bed")
        os.mkdir(path)
        for first, end in ((0, 10), (10, 11), (11, panel.p)):
            _write_bed(f"{path}/part-{first:012d}-x.bed", panel.raw[:, first:end])
        assert (_matrix(plink.read_bed(spark, path, panel.n), panel.n, panel.p) == panel.raw).all()
    raw = plink.read_bed_tiles(spark, path, panel.n, rows, cols)
    want = {(r.rb, r.cb): r.x for r in tile_table(panel.geno, "iid", "marker", "dosage", rows, cols).collect()}
    got = {(r.rb, r.cb): r.x for r in raw.collect()}
    assert got == want
    sums = qc.marker_sums_from_tiles(raw, rows, cols).toPandas().sort_values("marker").reset_index(drop=True)
    same = qc.marker_sums(panel.geno).toPandas().sort_values("marker").reset_index(drop=True)
    assert (sums[sorted(sums)].astype(int) == same[sorted(same)].astype(int)).all().all()


def test_analyses_on_tiles_equal_those_on_rows(spark, panel, files):
    raw = materialise(plink.read_bed_tiles(spark, files + ".bed", panel.n))
    report = materialise(qc.judge(qc.stats_from_sums(qc.marker_sums_from_tiles(raw))))
    kept, _ = qc.qc_markers(panel.geno)
    params = materialise(transform.params_from_stats(qc.kept_markers(report)))
    k = square(kinship.kinship_from_tiles(raw, params), panel.n)
    assert np.abs(k - square(kinship.kinship_additive(kept), panel.n)).max() < 1e-10
    a = ridge.ridge_cg_tiles(raw, panel.pheno, params, 300.0, 1e-6)
    b = ridge.ridge(kept, panel.pheno, 300.0)
    pair = a.withColumnRenamed("beta", "a").join(b, "marker").toPandas()
    assert len(pair) == b.count() == a.count() and np.abs(pair.a - pair.beta).max() < 1e-6
    s = score.score_tiles(raw, b, params, panel.n).toPandas().sort_values("iid").yhat.to_numpy()
    t = score.score_standardised(kept, b, params).toPandas().sort_values("iid").yhat.to_numpy()
    assert len(s) == panel.n and np.abs(s - t).max() < 1e-10
    one, two = (r.first() for r in (reml.reml_lanczos_tiles(raw, panel.pheno, params, 4, 4), reml.reml_lanczos(kept, panel.pheno, 4, 4)))
    assert abs(one.h2 - two.h2) < 1e-9 and abs(one.reml_ll - two.reml_ll) < 1e-7


def test_corrupt_files_are_refused(spark, tmp_path):
    bad = tmp_path / "a.bed"
    bad.write_bytes(bytes([1, 2, 3, 4]))
    with pytest.raises(Exception, match="not a valid"):
        plink.read_bed(spark, str(bad), 4).count()
    bad.write_bytes(bytes([108, 27, 0, 4]))
    with pytest.raises(Exception, match="SNP-major"):
        plink.read_bed(spark, str(bad), 4).count()
    bad.write_bytes(bytes([108, 27, 1, 4]))
    with pytest.raises(Exception, match="corrupt"):
        plink.read_bed(spark, str(bad), 9).count()


@pytest.mark.parametrize("layout", ["parts", "single"])
def test_write_bed(spark, panel, tmp_path, layout):
    out = str(tmp_path / "out.bed")
    plink.write_plink(panel.geno, out, panel.n, layout, panel.p)
    assert (_matrix(plink.read_bed(spark, out, panel.n), panel.n, panel.p) == panel.raw).all()
    if layout == "single":
        _write_bed(str(tmp_path / "want.bed"), panel.raw)
        assert open(out, "rb").read() == open(tmp_path / "want.bed", "rb").read()


@pytest.mark.parametrize("layout", ["parts", "single"])
def test_grm_files(spark, panel, tmp_path, layout):
    prefix = str(tmp_path / "k")
    table = kinship.kinship_additive(panel.geno).cache()
    ids = spark.range(panel.n).selectExpr("id as iid", "concat('F', id) as fid", "concat('I', id) as iid_str")
    grm.write_grm(table, prefix, panel.n, ids, layout)
    if layout == "parts":
        assert np.abs(square(grm.read_grm(spark, prefix)[0], panel.n) - square(table, panel.n)).max() < 1e-6
        for suffix in (".grm.bin", ".grm.N.bin"):
            folder = prefix + suffix + ".parts"
            with open(prefix + suffix, "wb") as f:
                for name in sorted(os.listdir(folder)):
                    if name.startswith("part-"):
                        f.write(open(f"{folder}/{name}", "rb").read())
    k = square(table, panel.n)
    raw = np.frombuffer(open(prefix + ".grm.bin", "rb").read(), "<f4")
    assert np.array_equal(raw, k[np.tril_indices(panel.n)].astype("<f4"))
    back, names = grm.read_grm(spark, prefix)
    assert np.abs(square(back, panel.n) - k).max() < 1e-6
    assert back.filter(f"n_snps <> {panel.p}").count() == 0
    assert [r.iid_str for r in names.orderBy("iid").collect()] == [f"I{i}" for i in range(panel.n)]
    assert grm.full_matrix(back).count() == panel.n ** 2
    if layout == "single":
        jobs.merge_files(spark, [prefix, prefix], str(tmp_path / "m"))
        merged, _ = grm.read_grm(spark, str(tmp_path / "m"))
        assert np.abs(square(merged, panel.n) - k).max() < 1e-6 and merged.first().n_snps == 2 * panel.p


@pytest.mark.parametrize("layout", ["parts", "single"])
def test_grm_files_of_tiles(spark, tmp_path, layout):
    """before, only long rows could be written, all of which were shuffled and computed twice."""
    from conftest import Panel

    panel = Panel(spark, n=700, p=5, missing=0.0)
    tiles = kinship.kinship_additive(panel.geno, form="tiles")
    rows = grm.triangle_rows(tiles, panel.n)
    plan = rows._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan
    prefix = str(tmp_path / "k")
    ids = spark.range(panel.n).selectExpr("id as iid", "concat('F', id) as fid", "concat('I', id) as iid_str")
    grm.write_grm(tiles, prefix, panel.n, ids, layout)
    back = grm.read_grm(spark, prefix)[0]
    want = (panel.z @ panel.z.T / panel.p).astype("<f4")
    got = back.toPandas()
    assert len(got) == panel.n * (panel.n + 1) // 2 and (got.n_snps == panel.p).all()
    assert np.abs(got.k.to_numpy() - want[got.i, got.j]).max() < 1e-6
    if layout == "parts":
        assert 2 <= len([x for x in os.listdir(prefix + ".grm.bin.parts") if x.startswith("part-")]) <= 11
        lacking = kinship.kinship_additive(panel.geno.where("iid <> 300"), form="tiles")
        with pytest.raises(Exception, match="needs every pair"):
            grm.write_grm(lacking, str(tmp_path / "m"), panel.n, ids)


def test_triangle_positions():
    offsets = np.arange(0, 5000)
    i, j = grm.triangle_position(offsets)
    assert (i * (i + 1) // 2 + j == offsets).all() and (j <= i).all() and (j >= 0).all()


def test_text_sources(spark, tmp_path):
    (tmp_path / "e.txt").write_text("rs1 A -0.5\nrs2 C 1.5\nrs3 G 0.5\n")
    stats = {r.rsid: (r.beta, r.scaled) for r in text.read_summary_stats(spark, str(tmp_path / "e.txt")).collect()}
    assert stats == {"rs1": (-0.5, 0.0), "rs2": (1.5, 1.0), "rs3": (0.5, 0.0)}
    assert [r.a1 for r in text.read_effects(spark, str(tmp_path / "e.txt")).orderBy("rsid").collect()] == ["A", "C", "G"]
    (tmp_path / "w.txt").write_text("name weight\nrs1 0.0\nrs2 2.5\n")
    assert {r.rsid: r.w for r in text.read_weights(spark, str(tmp_path / "w.txt")).collect()} == {"rs1": 0.0, "rs2": 2.5}
    (tmp_path / "r_region_number").write_text("1\n")
    for k, names in enumerate((["a", "b"], ["c"], ["z"])):
        (tmp_path / f"r_region{k}").write_text("\n".join(names) + "\n")
    members = text.read_region_members(spark, str(tmp_path / "r_")).orderBy("region_id", "position").collect()
    assert [(m.region_id, m.rsid, m.position) for m in members] == [(0, "a", 0), (0, "b", 1), (1, "c", 0)]
    (tmp_path / "h.reml").write_text("x\nHer_K1 0.000000 0.0\nHer_R1 0.2 0.1\ny\n")
    deltas = {r.region_id: r.delta for r in text.read_region_deltas(spark, str(tmp_path / "h.reml")).collect()}
    assert deltas[0] == pytest.approx(np.exp(10)) and deltas[1] == pytest.approx(4.0)
    for k, rows in ((1, "0\t5\t1.0\n3\t8\t2.0\n"), (2, "0\t4\t3.0\n"), (3, "0\t6\t4.0\n"), (5, "0\t9\t9.0\n")):
        (tmp_path / f"reg{k}.txt").write_text(rows)
    jobs.merge_region_files(spark, str(tmp_path / "reg"), str(tmp_path / "merged"))
    merged = sorted((r.start_idx, r.end_idx, r.delta) for r in text.read_regions(spark, str(tmp_path / "merged" / "*.csv")).collect())
    assert merged == [(0, 5, 1.0), (3, 8, 2.0), (8, 12, 3.0), (12, 18, 4.0)]
    (tmp_path / "p.txt").write_text("a a 1\nb b 2\n")
    recoded = {r.iid_str: r.y for r in text.read_pheno(spark, str(tmp_path / "p.txt"), True).collect()}
    assert recoded == {"a": 0.0, "b": 1.0}
    hot = {r.iid_str: r.y for r in text.read_pheno(spark, str(tmp_path / "p.txt"), True, False).collect()}
    assert hot == {"a": [1.0, 0.0], "b": [0.0, 1.0]}


def test_file_jobs_and_reports(spark, panel, files, tmp_path):
    jobs.dominance_files(spark, files, str(tmp_path / "dom"))
    got = _matrix(plink.read_bed(spark, str(tmp_path / "dom.bed"), panel.n), panel.n, panel.p)
    assert (got == np.where(panel.m == 2, 1, panel.m)).all()
    assert spark.read.text(str(tmp_path / "dom.bim")).count() == panel.p
    jobs.region_scan_files(spark, files, files + ".pheno", str(tmp_path / "scan"), 10, 5)
    lines = spark.read.text(str(tmp_path / "scan")).count()
    assert lines == 4
    samples = plink.read_fam(spark, files)
    pheno = text.by_position(text.read_pheno(spark, files + ".pheno"), samples).toPandas().sort_values("iid").y
    assert np.abs(pheno - panel.y).max() < 1e-6
    report = jobs.heritability(panel.pheno, geno=panel.geno)
    assert [r.name for r in sinks.h2_report(report).orderBy("line").collect()] == ["h2", "h2_se", "delta", "ve", "vg", "reml_ll"]
    sinks.write_h2_report(report, str(tmp_path / "h2"))
    sinks.write_profile(panel.pheno.withColumnRenamed("y", "yhat"), str(tmp_path / "profile"))
    sinks.write_pheno(samples.join(panel.pheno, "iid"), str(tmp_path / "pheno"))
    assert text.read_pheno(spark, str(tmp_path / "pheno")).count() == panel.n


def test_reader_works_in_a_session_with_default_settings(spark, panel, files):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    assert plink.read_bed(spark, files + ".bed", panel.n).filter("marker = 4").count() == panel.n


def test_lines_of_unequal_parts_keep_their_order(spark, tmp_path):
    """Parts of very different sizes, read with several tasks: numbers follow the names of the parts."""
    import os

    folder = tmp_path / "samples.fam"
    os.makedirs(folder)
    want, k = [], 0
    for part, n in enumerate((3, 900, 1, 200, 40)):
        with open(folder / f"part-{part:05d}.txt", "w") as f:
            for _ in range(n):
                f.write(f"F{k} I{k} 0 0 1 2\n")
                want.append(f"I{k}")
                k += 1
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = plink.read_fam(spark, str(tmp_path / "samples")).toPandas().sort_values("iid")
            assert list(rows.iid) == list(range(k)) and list(rows.iid_str) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_scratch_tables_are_removed_between_steps(spark, panel):
    import glob

    from locusframe.operators import ridge
    from locusframe.session import scratch_dir

    before = len(glob.glob(f"{scratch_dir(spark)}/*"))
    ridge.ridge_cg(panel.geno, panel.pheno, 50.0, 1e-8).count()
    # people, parameters, tile statistics and tiles, and the last state; not two tables for each step
    assert len(glob.glob(f"{scratch_dir(spark)}/*")) - before <= 8
