"""Marker quality control on long genotypes ``geno(iid, marker, dosage)``, -1 = missing call.

Every check is one ``groupBy(marker)`` over integer sums, so it combines map-side and a marker
that fills a third of the table still shuffles as one small row per task. The genotype table
itself is never shuffled: verdicts are one row per marker, written as a scratch table and joined
back (broadcast while small, sort-merge beyond that).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.functions.scalar import observed
from locusframe.operators.tiles import ABSENT, COLS, ROWS
from locusframe.session import materialise

# Default thresholds.
MIN_OBSERVED = 0.95
MIN_MAF = 0.01
MIN_VARIANCE = 0.02
DISABLED = -1


def marker_sums(geno: DataFrame, n_samples: int | None = None) -> DataFrame:
    """Integer sums per marker: with missing calls as 0 (``s1``, ``s2``) and as stored (``r1``, ``r2``).

    ``n_samples`` is for sparse tables that leave out zero cells.
    """
    d, g = F.col("dosage"), observed("dosage")
    n = F.lit(n_samples) if n_samples is not None else F.count(F.lit(1))
    sparse_min = F.least(F.min(g), F.when(F.count(F.lit(1)) < n, F.lit(0))) if n_samples is not None else F.min(g)
    return geno.groupBy("marker").agg(
        n.cast("long").alias("n"),
        F.count_if(d == -1).cast("long").alias("n_missing"),
        F.sum(g).cast("long").alias("s1"),
        F.sum(g * g).cast("long").alias("s2"),
        F.sum(d).cast("long").alias("r1"),
        F.sum(d * d).cast("long").alias("r2"),
        sparse_min.cast("int").alias("lo"),
        F.max(g).cast("int").alias("hi"),
    )


def _variance(n: str, s1: str, s2: str) -> Column:
    """Population variance from integer sums; exact up to the final division."""
    n_, a, b = (F.col(c).cast("double") for c in (n, s1, s2))
    return (n_ * b - a * a) / (n_ * n_)


def marker_sums_from_tiles(tiles: DataFrame, rows: int = ROWS, cols: int = COLS) -> DataFrame:
    """The same sums from a tile table: a task adds up the columns of each tile, one row per column and tile."""
    def run(batches):
        for batch in batches:
            for cb, x in zip(batch.column("cb").to_pylist(), batch.column("x")):
                raw = np.frombuffer(x.as_buffer(), np.int8).reshape(rows, cols)
                here = raw != ABSENT
                seen = np.flatnonzero(here.any(axis=0))
                raw, here = raw[:, seen].astype(np.int64), here[:, seen]
                raw[~here] = 0
                g = np.maximum(raw, 0)
                yield pa.record_batch({
                    "marker": pa.array((cb * cols + seen).astype(np.int32)), "n": here.sum(axis=0),
                    "n_missing": (raw == -1).sum(axis=0), "s1": g.sum(axis=0), "s2": (g * g).sum(axis=0),
                    "r1": raw.sum(axis=0), "r2": (raw * raw).sum(axis=0),
                    "lo": pa.array(np.where(here, g, 127).min(axis=0).astype(np.int32)),
                    "hi": pa.array(g.max(axis=0).astype(np.int32))})

    sums = ("n", "n_missing", "s1", "s2", "r1", "r2")
    parts = tiles.select("cb", "x").mapInArrow(
        run, "marker int, " + ", ".join(f"{c} long" for c in sums) + ", lo int, hi int")
    return parts.groupBy("marker").agg(*(F.sum(c).alias(c) for c in sums), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def marker_stats(geno: DataFrame, n_samples: int | None = None) -> DataFrame:
    """Counts, allele frequency (not folded), mean, population variance and sd, min and max."""
    return stats_from_sums(marker_sums(geno, n_samples))


def stats_from_sums(sums: DataFrame) -> DataFrame:
    var = _variance("n", "s1", "s2")
    return sums.select(
        "marker", "n", "n_missing",
        F.col("s1").alias("allele_count"),
        (F.col("s1") / (2.0 * F.col("n"))).alias("maf"),
        (F.col("s1") / F.col("n").cast("double")).alias("mean"),
        var.alias("variance"),
        F.sqrt(var).alias("sd"),
        "lo", "hi",
    )


def _fails_missing(min_observed: float) -> Column:
    return F.col("n_missing").cast("double") / F.col("n") >= F.lit(1.0) - F.lit(float(min_observed))


def qc_report(geno: DataFrame, min_observed: float = MIN_OBSERVED, min_maf: float = MIN_MAF,
              min_variance: float = MIN_VARIANCE, n_samples: int | None = None) -> DataFrame:
    """One row per marker with the first failing check (missing, maf, variance) or null.

    Missing calls count as 0 once the missing check is done; a threshold of -1 disables a check.
    """
    return judge(marker_stats(geno, n_samples), min_observed, min_maf, min_variance)


def judge(stats: DataFrame, min_observed: float = MIN_OBSERVED, min_maf: float = MIN_MAF,
          min_variance: float = MIN_VARIANCE) -> DataFrame:
    """The report from marker statistics, wherever they come from."""
    reason = F.lit(None).cast("string")
    checks = [
        ("variance", min_variance, F.col("variance") < F.lit(float(min_variance))),
        ("maf", min_maf, F.col("maf") < F.lit(float(min_maf))),
        ("missing", min_observed, _fails_missing(min_observed)),
    ]
    for label, threshold, failed in checks:
        if threshold != DISABLED:
            reason = F.when(failed, F.lit(label)).otherwise(reason)
    return stats.withColumn("reason", reason)


def kept_markers(report: DataFrame) -> DataFrame:
    return report.filter(F.col("reason").isNull())


def keep_markers(geno: DataFrame, markers: DataFrame, key: str = "marker") -> DataFrame:
    """Only the listed markers."""
    return geno.join(markers.select(key).distinct(), key, "left_semi")


def drop_markers(geno: DataFrame, markers: DataFrame, key: str = "marker") -> DataFrame:
    """All but the listed markers."""
    return geno.join(markers.select(key).distinct(), key, "left_anti")


def replace_missing(geno: DataFrame) -> DataFrame:
    return geno.withColumn("dosage", observed("dosage"))


def qc_markers(geno: DataFrame, min_observed: float = MIN_OBSERVED, min_maf: float = MIN_MAF,
               min_variance: float = MIN_VARIANCE) -> tuple[DataFrame, DataFrame]:
    """Apply the combined check: the kept genotypes (missing replaced) and the marker report."""
    report = materialise(qc_report(geno, min_observed, min_maf, min_variance))
    kept = kept_markers(report).select("marker")
    return geno.join(kept, "marker", "left_semi").withColumn("dosage", observed("dosage")), report


# Single-criterion verdicts. Unlike the combined check they look at the stored values, so a
# missing call enters sums and variances as -1.

def missing_verdict(geno: DataFrame, min_observed: float = MIN_OBSERVED) -> DataFrame:
    return marker_sums(geno).select(
        "marker", (F.col("n_missing").cast("double") / F.col("n")).alias("missing_rate"),
        (~_fails_missing(min_observed)).alias("kept"))


def rare_verdict(geno: DataFrame, min_maf: float = MIN_MAF) -> DataFrame:
    freq = F.col("r1") / (2.0 * F.col("n"))
    return marker_sums(geno).select("marker", freq.alias("maf"), (freq >= F.lit(float(min_maf))).alias("kept"))


def rare_verdict_from(freqs: DataFrame, min_maf: float = MIN_MAF) -> DataFrame:
    """The rare check on stored frequencies ``(marker, maf)``, without a pass over the genotypes."""
    return freqs.select("marker", "maf", (F.col("maf") >= F.lit(float(min_maf))).alias("kept"))


def monomorphic_verdict(geno: DataFrame) -> DataFrame:
    var = _variance("n", "r1", "r2")
    return marker_sums(geno).select("marker", F.sqrt(var).alias("sd"), (var != 0).alias("kept"))


def low_variance_verdict(geno: DataFrame, min_variance: float = MIN_VARIANCE) -> DataFrame:
    var = _variance("n", "r1", "r2")
    return marker_sums(geno).select(
        "marker", var.alias("variance"), (var >= F.lit(float(min_variance))).alias("kept"))


def apply_verdict(geno: DataFrame, verdict: DataFrame) -> DataFrame:
    """The genotypes of the markers a verdict keeps, values as stored."""
    kept = materialise(verdict.filter("kept").select("marker"))
    return geno.join(kept, "marker", "left_semi")


def union_failures(train: DataFrame, valid: DataFrame, **thresholds) -> DataFrame:
    """Markers that fail the combined check in the training or in the validation set."""
    failed = [qc_report(g, **thresholds).filter(F.col("reason").isNotNull()).select("marker")
              for g in (train, valid)]
    return failed[0].union(failed[1]).distinct()


def qc_union(train: DataFrame, valid: DataFrame, **thresholds) -> tuple[DataFrame, DataFrame]:
    """Both sets without the union of their failing markers, missing replaced."""
    failed = materialise(union_failures(train, valid, **thresholds))
    return tuple(replace_missing(g.join(failed, "marker", "left_anti")) for g in (train, valid))


def drop_zero_weights(weights: DataFrame) -> DataFrame:
    """Markers of weight 0 leave the weight table (and, by join, the genotypes)."""
    return weights.filter(F.col("w") != 0)


def drop_max_shrinkage(lambdas: DataFrame, limit: float) -> DataFrame:
    """Markers whose shrinkage reaches ``limit`` are of no use as predictors."""
    return lambdas.filter(F.col("lambda") < F.lit(limit))


def nan_markers(z: DataFrame, value: str = "z") -> DataFrame:
    """Markers with any NaN (or null) value."""
    bad = F.isnan(value) | F.col(value).isNull()
    return z.groupBy("marker").agg(F.bool_or(bad).alias("bad")).filter("bad").select("marker")


def drop_nan_markers(z: DataFrame, effects: DataFrame, value: str = "z") -> tuple[DataFrame, DataFrame]:
    """Remove markers with NaN values from the scoring matrix and from the effects."""
    bad = materialise(nan_markers(z, value))
    return z.join(bad, "marker", "left_anti"), effects.join(bad, "marker", "left_anti")
