"""End-to-end analyses: from tables to result tables.

Each function takes and returns DataFrames; ``*_files`` variants read and write the file formats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.operators import grm_factors, grm_tiles, haseman_elston, kinship, network, qc, regression, reml, ridge, sampling, scan, score, transform
from locusframe.operators.align import complete_cases, concat_regions, region_order, resolve_rsids
from locusframe.functions.scalar import MAX_DELTA
from locusframe.session import materialise
from locusframe.sources import grm as grm_io
from locusframe.sources import plink, sinks, text


def association(geno: DataFrame, pheno: DataFrame, bonferroni: bool = True) -> DataFrame:
    """Which markers pass QC and are associated with the phenotype."""
    kept, report = qc.qc_markers(geno)
    return regression.uni_reg(kept, pheno, bonferroni).join(report.select("marker", "maf"), "marker", "left")


def association_files(spark: SparkSession, path: str, n_samples: int, pheno: DataFrame, bonferroni: bool = True, **thresholds) -> DataFrame:
    """The same straight from a packed genotype file, for one phenotype ``(iid, y)`` or many ``(iid, trait, y)`` in one pass over its tiles."""
    stored, report, params = tile_study(spark, path, n_samples, **thresholds)
    return regression.uni_reg_tiles(stored, pheno, params, bonferroni).join(report.select("marker", "maf"), "marker", "left")


def tile_study(spark: SparkSession, path: str, n_samples: int, **thresholds) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A genotype file as stored tiles with its QC report and the standardisation of the kept markers.

    This is the way in for files too large to be spread out as one row per genotype: the tiles feed
    ``kinship_from_tiles``, ``ridge_cg_tiles``, ``reml_lanczos_tiles`` and ``score_tiles``.
    """
    tiles = materialise(plink.read_bed_tiles(spark, path, n_samples))
    report = materialise(qc.judge(qc.stats_from_sums(qc.marker_sums_from_tiles(tiles)), **thresholds))
    return tiles, report, materialise(transform.params_from_stats(qc.kept_markers(report)))


def dominance_files(spark: SparkSession, prefix: str, out: str) -> None:
    """Recode a data set to dominance contrasts (missing replaced) next to unchanged marker and sample lines."""
    geno, markers, samples = plink.read_plink(spark, prefix)
    recoded = transform.dominance_recode(qc.replace_missing(geno))
    plink.write_plink(recoded, out + ".bed", samples.count())
    plink.write_lines(plink.bim_lines(markers.withColumn("rsid", F.col("original"))), out + ".bim")
    plink.write_lines(plink.fam_lines(samples), out + ".fam")


def kinship_job(geno: DataFrame, ld_weights: DataFrame | None = None, maf_alpha: float | None = None,
                dominance: bool = False, weight_mode: str = "post") -> dict[str, DataFrame]:
    """QC, optional marker weights, then the additive (and dominance) relationship matrix."""
    kept, report = qc.qc_markers(geno)
    if ld_weights is None and maf_alpha is None:
        out = {"additive": kinship.kinship_additive(kept)}
        if dominance:
            out["dominance"] = kinship.kinship_dominance(kept)
        return out
    weights = kinship.marker_weights(report, ld_weights, maf_alpha)
    out = {"additive": kinship.kinship_weighted(kept, weights, weight_mode)}
    if dominance:
        out["dominance"] = kinship.kinship_weighted(kept, weights, weight_mode, dominance=True)
    return out


def merge_files(spark: SparkSession, prefixes: list[str], out: str) -> None:
    """Merge stored relationship matrices on ids and write the result."""
    parts, ids = [], None
    for prefix in prefixes:
        grm, names = grm_io.read_grm(spark, prefix)
        if ids is None:
            ids, local = names, grm
        else:
            place = names.join(ids.select("fid", "iid_str", F.col("iid").alias("_to")), ["fid", "iid_str"]).select("iid", "_to")
            moved = grm.join(place.withColumnRenamed("iid", "i").withColumnRenamed("_to", "_i"), "i").join(
                place.withColumnRenamed("iid", "j").withColumnRenamed("_to", "_j"), "j")
            local = moved.select(F.greatest("_i", "_j").alias("i"), F.least("_i", "_j").alias("j"), "k", "n_snps")
        parts.append(local)
    grm_io.write_grm(kinship.merge_kinships(parts), out, ids.count(), ids)


def heritability(pheno: DataFrame, geno: DataFrame | None = None, grm: DataFrame | None = None,
                 eig: DataFrame | None = None, method: str = "lanczos", covariates: DataFrame | None = None) -> DataFrame:
    """Heritability report from genotypes, a relationship matrix (factors, tiles or long rows) or a stored eigen summary.

    ``method`` is that of ``reml.reml``: ``lanczos`` has no bound on people or markers; with a relationship matrix any other is exact.
    ``covariates(iid, cov, value)`` are fixed effects (not with an eigen summary, which holds its own projection).
    """
    if eig is not None:
        if covariates is not None:
            raise ValueError("an eigen summary has no further fixed effects")
        return reml.reml_from_eigen(eig, trait(pheno, eig.select(F.explode("ids").alias("iid"))))
    if grm is not None:
        y = trait(pheno, _complete(_inside(grm), covariates))
        factored = isinstance(grm, grm_factors.Factors)
        if method == "lanczos":
            return reml.reml_lanczos_from_grm(grm_factors.as_tiles(grm) if factored else grm, y, covariates=covariates)
        if factored:
            return reml.reml_from_factors(grm, y, covariates)
        return reml.reml_from_grm(grm_tiles.pairs(grm) if grm_tiles.is_tiled(grm) else grm, y, covariates)
    if geno is None:
        raise ValueError("genotypes, a relationship matrix or an eigen summary is required")
    kept, _ = qc.qc_markers(geno)
    return reml.reml(kept, trait(pheno, _complete(kept, covariates)), method, covariates)


def _inside(grm) -> DataFrame:
    """The individuals of a relationship matrix in any form."""
    if isinstance(grm, grm_factors.Factors):
        return grm_factors.individuals(grm)
    return grm_tiles.individuals(grm) if grm_tiles.is_tiled(grm) else grm.where("i = j").select(F.col("i").alias("iid"))


def _complete(ids: DataFrame, covariates: DataFrame | None) -> DataFrame:
    ids = ids.select("iid").distinct()
    return ids if covariates is None else ids.join(complete_cases(covariates), "iid", "left_semi")


def trait(pheno: DataFrame, ids: DataFrame) -> DataFrame:
    """The standardised phenotype of those who have one and are in ``ids(iid)``: who takes no part in a fit has no part in its scale."""
    known = pheno.where("y is not null").select("iid", "y")
    return transform.standardise_pheno(known.join(ids.select("iid").distinct(), "iid", "left_semi"))


def variance_components(pheno: DataFrame, grm: DataFrame, epi: int = 1, dominance: DataFrame | None = None,
                        residual: bool = False) -> tuple[DataFrame, DataFrame]:
    """Haseman-Elston models of a relationship matrix, in factors, tiles or long rows."""
    return haseman_elston.he_regression(grm, trait(pheno, _inside(grm)), epi, dominance, residual)


def variance_components_from_genotypes(geno: DataFrame, pheno: DataFrame, epi: int = 1, dominance: bool = False,
                                       covariates: DataFrame | None = None, residual: bool = False) -> tuple[DataFrame, DataFrame]:
    """The same models straight from genotypes; covariates are a further component."""
    return haseman_elston.he_regression_from_genotypes(geno, trait(pheno, geno), epi, residual, dominance, covariates)


def region_scan_files(spark: SparkSession, prefix: str, pheno_path: str, out: str, block: int = 50, stride: int = 25) -> None:
    geno, markers, samples = plink.read_plink(spark, prefix)
    pheno = text.by_position(text.read_pheno(spark, pheno_path), samples)
    report = materialise(qc.qc_report(geno))
    sinks.write_regions(scan.scan_regions(geno, pheno, block, stride, report=report), out)
    sinks.write_table(sinks.kept_marker_list(report, markers), out + "_markers")


def region_scan_tiles(spark: SparkSession, path: str, n_samples: int, pheno: DataFrame, block: int = 50, stride: int = 25,
                      covariates: DataFrame | None = None, **thresholds) -> DataFrame:
    """The scan straight from a packed genotype file, without a row per genotype."""
    stored, report, _params = tile_study(spark, path, n_samples, **thresholds)
    return scan.scan_tiles(stored, pheno, block, stride, covariates, report)


def merge_region_files(spark: SparkSession, prefix: str, out: str) -> None:
    """Append ``<prefix>1.txt, <prefix>2.txt, ..`` into one region file."""
    merged = concat_regions(text.read_region_files(spark, prefix))
    sinks._text(merged, out, ["file_no", "row_no"], ["start_idx", "end_idx", "delta"])


def ridge_blup(geno: DataFrame, pheno: DataFrame, valid: DataFrame, h2: float, priors: DataFrame | None = None,
               own_scale: bool = True, method: str = "gradients") -> tuple[DataFrame, DataFrame]:
    """Fit on the training set, predict the validation set: ``(predictions, effects)``.

    ``own_scale`` standardises the validation set by its own mean and sd, otherwise by the training
    parameters. Markers whose validation z-scores are not numbers leave.
    """
    y = transform.standardise_pheno(pheno)
    kept, report = qc.qc_markers(geno)
    delta = (1.0 - h2) / h2
    if priors is not None:
        effects = ridge.ridge_hetero(kept, y, priors, h2, "gradients" if method == "gradients" else "direct")
    else:
        effects = ridge.fit_effects(kept, y, delta, method)
    held = valid.join(report.filter("reason is null").select("marker"), "marker", "left_semi")
    params = materialise(transform.scale_params(held if own_scale else kept))
    usable = params.filter(~F.isnan("mean") & ~F.isnan("sd"))
    return score.score_standardised(held, effects, usable), effects


def effects_job(geno: DataFrame, pheno: DataFrame, markers: DataFrame, delta: float = -1.0, apply_qc: bool = True,
                valid: DataFrame | None = None, method: str = "gradients") -> dict[str, DataFrame]:
    """Least squares or ridge effects with names and alleles, kept markers, and predictions of a
    validation set on the training scale."""
    y = transform.standardise_pheno(pheno)
    report = None
    if apply_qc:
        kept, report = qc.qc_markers(geno)
    else:
        kept = qc.replace_missing(geno)
    params = materialise(transform.scale_params(kept))
    effects = materialise(ridge.fit_effects(kept, y, delta, method))
    out = {"effects": effects.join(markers.select("marker", "rsid", "a1"), "marker").select("marker", "rsid", "a1", "beta"),
           "params": params}
    if report is not None:
        out["kept"] = sinks.kept_marker_list(report, markers)
    if valid is not None:
        out["predictions"] = score.score_standardised(valid, effects, params)
    return out


def score_job(geno: DataFrame, effects: DataFrame, markers: DataFrame) -> DataFrame:
    """Scores of new individuals from stored effects, matched by name and allele."""
    return score.score_by_allele(geno, effects, markers)


def region_shrinkage(geno: DataFrame, pheno: DataFrame, markers: DataFrame, members: DataFrame,
                     deltas: DataFrame, method: str = "gradients") -> tuple[DataFrame, DataFrame]:
    """Effects with one shrinkage per region: ``(effects, ordered)``; markers with the largest shrinkage leave."""
    found, missing = resolve_rsids(members.drop("marker"), markers)
    lost = missing.limit(1).collect()
    if lost:
        raise ValueError(f"marker of a region not found: {lost[0].rsid}")
    ordered = region_order(found)
    lambdas = materialise(qc.drop_max_shrinkage(
        transform.region_lambda(ordered, deltas), MAX_DELTA).select("marker", "lambda", "new_idx"))
    kept, _ = qc.qc_markers(geno.join(lambdas, "marker", "left_semi"))
    return ridge.ridge_by_lambda(kept, transform.standardise_pheno(pheno), lambdas, method), lambdas


def neural_prediction(geno: DataFrame, pheno: DataFrame, valid: DataFrame, valid_pheno: DataFrame,
                      plan: network.TrainingPlan, hidden: int = 1, first_layer: int = 8, reduction: int = 1,
                      activation: str = "sigmoid", batch_size: int = 0, seed: int = 1, early_stop: bool = False,
                      cases: DataFrame | None = None, apply_qc: bool = True, classes: int = 0) -> dict[str, DataFrame]:
    """QC, standardise, train and predict: tables of predictions, r2, history, weights and scale parameters.

    ``cases`` (ids) switches oversampling on: cases are drawn with replacement until there are as many
    as others, before QC. With ``classes`` phenotypes are classes from 0 on: the network is a softmax over them, predictions have a
    probability per class, and ``confusion`` and ``class_report`` take the place of r2.
    """
    def outcome(table: DataFrame) -> DataFrame:
        return table.filter("y is not null") if classes else transform.standardise_pheno(table)

    y = outcome(pheno)
    if cases is not None:
        plan_rows = materialise(sampling.oversample_plan(y, cases, seed))
        geno = sampling.oversample(geno, plan_rows).select(F.col("row_id").alias("iid"), "marker", "dosage")
        y = sampling.oversample(y, plan_rows).select(F.col("row_id").alias("iid"), "y")
    train, report = qc.qc_markers(geno) if apply_qc else (qc.replace_missing(geno), None)
    z, params = transform.standardise(train)
    names = params.select("marker").orderBy("marker").limit(network.MAX_PARAMETERS + 1).toPandas()["marker"].tolist()
    rows = network.training_table(z, y, names, batch_size, seed)
    held = materialise(network.wide(transform.standardise_with(valid, params), names).join(
        outcome(valid_pheno), "iid"))
    net = network.init_network(names, network.layer_widths(hidden, first_layer, reduction), classes or 1, activation, seed,
                               "softmax" if classes else "squared")
    fit = network.train_until_best if early_stop else network.train
    trained = fit(rows, net, plan, held)
    predictions = network.predict_many(held, {0: trained.network}, with_y=True)
    if classes:
        cells = materialise(network.confusion(held, {0: trained.network}))
        measured = {"predictions": predictions.drop("model"), "confusion": cells.drop("model"),
                    "class_report": network.class_report(cells).drop("model")}
    else:
        predictions = predictions.select("iid", "y", "yhat")
        measured = {"predictions": predictions, "r2": score.r2(predictions)}
    out = {**measured,
           "history": network.history_table(geno.sparkSession, trained),
           "weights": network.network_table(geno.sparkSession, trained.network), "params": params}
    if report is not None:
        out["report"] = report
    return out


def neural_inference(geno: DataFrame, weights: DataFrame, params: DataFrame, activation: str = "sigmoid",
                     linear: bool = False, loss: str = "squared") -> DataFrame:
    """Predictions of new individuals from stored weights and training scale; ``linear`` drops activations.

    All outputs are scored, a row each where there are several; with the loss ``softmax`` as probabilities.
    """
    net = network.load_network(weights, activation, loss)
    rows = network.wide(transform.standardise_with(geno, params), net.markers)
    return network.predict(rows, net, linear)
