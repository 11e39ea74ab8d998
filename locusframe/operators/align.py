"""Alignments between tables by id, set operations, orders and minibatches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions.ranking import SPAN, index_by_hash, with_row_index
from locusframe.session import materialise


def with_pheno(geno: DataFrame, pheno: DataFrame) -> DataFrame:
    """Genotypes of the individuals that have a phenotype."""
    return geno.join(pheno, "iid")


def with_effects(geno: DataFrame, effects: DataFrame, markers: DataFrame) -> DataFrame:
    """Genotypes next to effects by rsid; where the effect allele is the other one, dosage is flipped.

    Effects whose allele matches neither allele of the marker drop out.
    """
    keyed = markers.select("marker", "rsid", F.col("a1").alias("_a1"), F.col("a2").alias("_a2"))
    oriented = effects.join(keyed, "rsid").filter((F.col("a1") == F.col("_a1")) | (F.col("a1") == F.col("_a2")))
    flipped = F.col("a1") != F.col("_a1")
    small = materialise(oriented.select("marker", "rsid", "beta", flipped.alias("_flip")))
    copies = F.when(F.col("dosage") == -1, F.lit(0)).when(F.col("_flip"), 2 - F.col("dosage")).otherwise(F.col("dosage"))
    return geno.join(small, "marker").select("iid", "marker", "rsid", "beta", copies.alias("dosage"))


def resolve_rsids(wanted: DataFrame, markers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Marker positions of listed rsids, and the rsids that do not exist."""
    names = markers.select("marker", "rsid")
    return wanted.join(names, "rsid"), wanted.join(names, "rsid", "left_anti").select("rsid").distinct()


def split_cases(samples: DataFrame, case_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cases (listed ids that exist) and everybody else."""
    ids = case_ids.select("iid").distinct()
    return samples.join(ids, "iid", "left_semi"), samples.join(ids, "iid", "left_anti")


def concat_chromosomes(geno: DataFrame, markers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Column-bind chromosomes: ``(chrom_no, marker)`` becomes one running marker position.

    ``markers`` has ``chrom_no`` and a 0-based ``marker`` within the chromosome.
    """
    sizes = markers.groupBy("chrom_no").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("chrom_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(sizes.select("chrom_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_off")))
    shift = lambda t: (t.join(offsets, "chrom_no")
                       .withColumn("marker", (F.col("marker") + F.col("_off")).cast("int")).drop("_off"))
    return shift(geno), shift(markers)


def concat_regions(regions: DataFrame) -> DataFrame:
    """Append region files ``(file_no, row_no, start_idx, end_idx, delta)``; each is shifted by the end of
    the last region appended so far."""
    last = regions.groupBy("file_no").agg(F.max_by("end_idx", "row_no").alias("_end"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = last.select("file_no", F.coalesce(F.sum("_end").over(before), F.lit(0)).alias("_off"))
    return regions.join(offsets, "file_no").select(
        "file_no", "row_no",
        (F.col("start_idx") + F.col("_off")).cast("long").alias("start_idx"),
        (F.col("end_idx") + F.col("_off")).cast("long").alias("end_idx"), "delta")


def region_order(members: DataFrame) -> DataFrame:
    """Position of each marker when markers are put in region order ``(region_id, position)``.

    Regions can be large (the background one), so positions are cut into buckets per region.
    """
    bucketed = members.withColumn("_block", F.floor(F.col("position") / SPAN))
    key = F.struct("region_id", "_block")
    return with_row_index(bucketed, ["position"], key, name="new_idx").drop("_block")


def shuffled(samples: DataFrame, seed: int, key: str = "iid") -> DataFrame:
    """Seeded random permutation of individuals as a position column ``idx``."""
    return index_by_hash(samples, key, seed)


def minibatches(samples: DataFrame, batch_size: int, seed: int, total: int | None = None) -> DataFrame:
    """Number shuffled rows in batches of ``batch_size`` (0 = one batch); ``is_remainder`` marks the
    incomplete last batch, which training skips and prediction keeps."""
    n = total if total is not None else samples.count()
    size = batch_size or max(n, 1)
    full = n // size
    batch = F.floor(F.col("idx") / size).cast("int")
    return shuffled(samples, seed).withColumn("batch_id", batch).withColumn("is_remainder", batch >= full)


def top_by_strength(scores: DataFrame, k: int, strength: str = "strength", *ties: str) -> DataFrame:
    """The report of the k strongest rows by absolute value (a TakeOrdered plan, no full sort)."""
    return scores.orderBy(F.abs(strength).desc(), *ties).limit(k)


def complete_cases(covariates: DataFrame) -> DataFrame:
    """``iid`` of those with a value of every covariate."""
    given = covariates.where("value is not null")
    many = given.agg(F.countDistinct("cov")).first()[0]
    return given.groupBy("iid").agg(F.countDistinct("cov").alias("_n")).where(F.col("_n") == many).select("iid")
