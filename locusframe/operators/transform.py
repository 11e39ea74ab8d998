"""Standardisation and recoding of genotypes and phenotypes.

Standardising is two column-pruned scans and no shuffle of the genotypes: per-marker parameters
come from one partial aggregate, go to a small scratch table and are joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.functions.scalar import dominance, h2_to_delta, observed
from locusframe.operators.qc import marker_stats
from locusframe.session import materialise


def scale_params(geno: DataFrame, epsilon: float | None = None) -> DataFrame:
    """``marker_stats(marker, mean, sd)`` for standardising; a zero sd becomes 1 so it never divides by zero."""
    return params_from_stats(marker_stats(geno), epsilon)


def params_from_stats(stats: DataFrame, epsilon: float | None = None) -> DataFrame:
    sd = F.col("sd") if epsilon is None else F.col("sd") + F.lit(epsilon)
    return stats.select("marker", "mean", F.when(sd == 0, 1.0).otherwise(sd).alias("sd"))


def standardise_with(geno: DataFrame, params: DataFrame) -> DataFrame:
    """z-score with given parameters, e.g. those of the training set. Unknown markers drop out."""
    return geno.join(params.select("marker", "mean", "sd"), "marker").select(
        "iid", "marker", ((observed("dosage") - F.col("mean")) / F.col("sd")).alias("z"))


def standardise(geno: DataFrame, epsilon: float | None = None) -> tuple[DataFrame, DataFrame]:
    """z-score with the table's own mean and population sd; also returns the parameters."""
    params = materialise(scale_params(geno, epsilon))
    return standardise_with(geno, params), params


def standardise_strict(geno: DataFrame) -> DataFrame:
    """z-score that fails when any marker is monomorphic."""
    params = materialise(marker_stats(geno).select(
        "marker", "mean",
        F.when(F.col("variance") == 0,
               F.raise_error(F.concat(F.lit("marker "), F.col("marker").cast("string"), F.lit(" is monomorphic"))))
        .otherwise(F.col("sd")).cast("double").alias("sd")))
    return standardise_with(geno, params)


def minmax_01(geno: DataFrame) -> DataFrame:
    """Scale each marker to 0..1; unchanged when its range is 0."""
    ends = materialise(marker_stats(geno).select("marker", "lo", "hi"))
    g, span = observed("dosage").cast("double"), F.col("hi") - F.col("lo")
    return geno.join(ends, "marker").select(
        "iid", "marker", F.when(span == 0, g).otherwise((g - F.col("lo")) / span).alias("value"))


def dominance_recode(geno: DataFrame) -> DataFrame:
    return geno.withColumn("dosage", dominance("dosage"))


def standardise_pheno(pheno: DataFrame) -> DataFrame:
    """z-score of y with the population sd, taken from a scalar subquery.

    The result is stored: its true size lets Spark broadcast it to the genotypes instead of
    shuffling them.
    """
    moments = pheno.agg(F.struct(F.avg("y").alias("m"), F.stddev_pop("y").alias("s"))).scalar()
    scaled = pheno.select("iid", "y", moments.alias("_m"))
    sd = F.when(F.col("_m.s") == 0, 1.0).otherwise(F.col("_m.s"))
    return materialise(scaled.select("iid", ((F.col("y") - F.col("_m.m")) / sd).alias("y")))


def region_lambda(members: DataFrame, deltas: DataFrame) -> DataFrame:
    """Each marker inherits the delta of its region: ``(region_id, rsid, lambda)``."""
    return members.join(deltas, "region_id").withColumnRenamed("delta", "lambda")


def deltas_from_h2(h2: DataFrame) -> DataFrame:
    return h2.select("region_id", h2_to_delta("h2").alias("delta"))


def scale_prior(effects: DataFrame, value: str = "beta") -> DataFrame:
    """Absolute effects scaled to 0..1; unchanged when all are equal. The ends come from a scalar subquery."""
    size = F.abs(value)
    ends = effects.agg(F.struct(F.min(size).alias("lo"), F.max(size).alias("hi"))).scalar()
    span = F.col("_e.hi") - F.col("_e.lo")
    return (effects.withColumn("_e", ends)
            .withColumn("scaled", F.when(span == 0, size).otherwise((size - F.col("_e.lo")) / span))
            .drop("_e"))
