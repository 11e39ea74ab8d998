"""Polygenic scores and prediction metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.functions.scalar import observed
from locusframe.operators.align import with_effects
from locusframe.operators.ridge import from_blocks, tile_times, to_blocks
from locusframe.operators.tiles import COLS, ROWS, block_counts, with_stats
from locusframe.session import materialise


def polygenic_score(z: DataFrame, effects: DataFrame, value: str = "z", people: DataFrame | None = None) -> DataFrame:
    """``yhat = sum(value x beta)`` per individual; effects are keyed by marker.

    In a sparse table whoever has no row has all-zero genotypes: with ``people(iid)`` they score 0 instead of being absent.
    """
    small = materialise(effects.select("marker", "beta"))
    scores = z.join(small, "marker").groupBy("iid").agg(F.sum(F.col(value) * F.col("beta")).alias("yhat"))
    if people is None:
        return scores
    return people.select("iid").distinct().join(scores, "iid", "left").select("iid", F.coalesce("yhat", F.lit(0.0)).alias("yhat"))


def score_standardised(geno: DataFrame, effects: DataFrame, params: DataFrame) -> DataFrame:
    """The score of z-scored dosages without forming them: ``sum(g b/sd) - sum(mean b/sd)``.

    The constant is folded into the small side, so the genotypes meet one joined table and one
    partial aggregate. That side is stored because Spark's size estimate of a join is a product.
    """
    unit = materialise(effects.join(params, "marker").select(
        "marker", (F.col("beta") / F.col("sd")).alias("_u"), (F.col("mean") * F.col("beta") / F.col("sd")).alias("_m")))
    return geno.join(unit, "marker").groupBy("iid").agg(
        F.sum(observed("dosage") * F.col("_u") - F.col("_m")).alias("yhat"))


def score_tiles(tiles: DataFrame, effects: DataFrame, params: DataFrame, n_samples: int, rows: int = ROWS,
                cols: int = COLS) -> DataFrame:
    """The same from a raw tile table: one product with the effects, no long rows."""
    used = materialise(params.join(effects.select("marker", "beta"), "marker"))
    ready = with_stats(tiles, used, cols=cols)
    shape = block_counts(tiles)
    out = tile_times(ready, shape, to_blocks(used, "marker", "beta", cols), rows, cols, transpose=False)
    return from_blocks(out, "v", rows, "iid", "yhat").filter(F.col("iid") < n_samples).withColumn("iid", F.col("iid").cast("long"))


def score_by_allele(geno: DataFrame, effects: DataFrame, markers: DataFrame) -> DataFrame:
    """Score by rsid with the effect allele checked; dosage is flipped where the other allele is meant."""
    return with_effects(geno, effects, markers).groupBy("iid").agg(
        F.sum(F.col("dosage") * F.col("beta")).alias("yhat"))


def r2(predictions: DataFrame) -> DataFrame:
    """Squared correlation of ``y`` and ``yhat`` over all rows."""
    return predictions.agg(F.pow(F.corr("y", "yhat"), F.lit(2.0)).alias("r2"))


def batch_r2(predictions: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Mean of the squared correlations per batch, rounded to 5 digits."""
    per = predictions.groupBy(batch).agg(F.pow(F.corr("y", "yhat"), F.lit(2.0)).alias("r"))
    return per.agg(F.round(F.avg("r"), 5).alias("r2"))


def _top(col: str):
    return F.array_position(F.col(col), F.array_max(col))


def accuracy(predictions: DataFrame) -> DataFrame:
    """Share of rows whose largest predicted class (array ``yhat``) is the largest true class (``y``)."""
    return predictions.agg(F.avg((_top("yhat") == _top("y")).cast("double")).alias("accuracy"))


def neg_mae(predictions: DataFrame) -> DataFrame:
    return predictions.agg((-F.avg(F.abs(F.col("yhat") - F.col("y")))).alias("neg_mae"))


def relative_mae(predictions: DataFrame) -> DataFrame:
    """Per-row error at the true class relative to the truth, summed (arrays ``yhat`` and ``y``)."""
    truth = F.array_max("y")
    error = F.abs(F.element_at("yhat", _top("y").cast("int")) - truth) / truth
    return predictions.agg(F.sum(F.abs(error)).alias("relative_mae"))


def redundancy(cells: DataFrame, gram_rows: DataFrame, n: int) -> DataFrame:
    """Decorrelation cost of features from their products ``(i, j, s)`` and cells ``(iid, marker, value)``:
    half the sum of squared covariances off the diagonal (the trace of the squared matrix)."""
    means = cells.groupBy("marker").agg((F.sum("value") / n).alias("m"))
    cov = gram_rows.filter("i <> j").join(means.select(F.col("marker").alias("i"), F.col("m").alias("mi")), "i").join(
        means.select(F.col("marker").alias("j"), F.col("m").alias("mj")), "j").select(
        (F.col("s") / n - F.col("mi") * F.col("mj")).alias("c"))
    return cov.agg(F.sum(F.col("c") * F.col("c")).alias("decorrelation_cost"))
