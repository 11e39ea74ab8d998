"""Result writers: plain tables and delimited text in a stated order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str) -> None:
    """Parameters, weights, effects, eigen summaries and relationship matrices as parquet."""
    df.write.mode("overwrite").parquet(path)


def _text(df: DataFrame, path: str, order: list[str], columns: list[str], sep: str = "\t", header: bool = False) -> None:
    (df.repartitionByRange(*order).sortWithinPartitions(*order).select(*columns)
     .write.mode("overwrite").option("sep", sep).option("header", header).csv(path))


def write_pheno(pheno: DataFrame, path: str) -> None:
    """``fid iid value`` lines by position."""
    _text(pheno, path, ["iid"], ["fid", "iid_str", "y"])


def write_regions(regions: DataFrame, path: str) -> None:
    _text(regions, path, ["start_idx", "end_idx"], ["start_idx", "end_idx", "delta"])


def write_region_members(members: DataFrame, path: str) -> None:
    """``(region_id, rsid, position)`` as one folder of sorted lines per region, ``region0 ..``, next to their highest number."""
    ids = sorted(r.region_id for r in members.select("region_id").distinct().collect())  # a folder each
    for k in ids:
        own = members.where(F.col("region_id") == k)
        own.repartitionByRange("position").sortWithinPartitions("position").select("rsid").write.mode("overwrite").text(f"{path}region{k}")
    top = members.sparkSession.createDataFrame([(str(ids[-1] if ids else 0),)], "value string")
    top.coalesce(1).write.mode("overwrite").text(f"{path}region_number")


def write_effects(effects: DataFrame, path: str, with_allele: bool = True) -> None:
    columns = ["rsid", "a1", "beta"] if with_allele else ["rsid", "beta"]
    _text(effects, path, ["marker"], columns, sep=" " if with_allele else "\t")


def write_predictions(predictions: DataFrame, metrics: DataFrame | None, path: str) -> None:
    """One table (fid, iid_str, yhat) and the one-row metric table."""
    predictions.write.mode("overwrite").parquet(f"{path}/yhat")
    if metrics is not None:
        metrics.write.mode("overwrite").parquet(f"{path}/metrics")


def write_profile(predictions: DataFrame, path: str) -> None:
    """Predicted values in sample order under the header ``Profile``."""
    _text(predictions.withColumnRenamed("yhat", "Profile"), path, ["iid"], ["Profile"], header=True)


def h2_report(reml: DataFrame) -> DataFrame:
    """The heritability report as ``(name, value)`` lines in their usual order."""
    fields = ["h2", "h2_se", "delta", "ve", "vg", "reml_ll"]
    return reml.select(F.posexplode(F.array(*(F.struct(F.lit(f).alias("name"), F.col(f).alias("value")) for f in fields)))
                       .alias("line", "c")).select("line", "c.name", "c.value")


def write_h2_report(reml: DataFrame, path: str) -> None:
    lines = h2_report(reml).select("line", F.concat_ws("=", "name", F.col("value").cast("string")).alias("value"))
    lines.repartitionByRange(1, "line").sortWithinPartitions("line").select("value").write.mode("overwrite").text(path)


def write_vc_report(models: DataFrame, components: DataFrame, path: str) -> None:
    models.write.mode("overwrite").parquet(f"{path}/vc_model")
    components.write.mode("overwrite").parquet(f"{path}/vc_component")


def training_curve(history: DataFrame) -> DataFrame:
    """``(epoch, split, metric)`` from one row per evaluated epoch."""
    return history.select("epoch", F.explode(F.array(
        F.struct(F.lit("train").alias("split"), F.col("train").alias("metric")),
        F.struct(F.lit("test").alias("split"), F.col("test").alias("metric")))).alias("c")).select(
        "epoch", "c.split", "c.metric").filter(F.col("metric").isNotNull())


def kept_marker_list(report: DataFrame, markers: DataFrame) -> DataFrame:
    """Names and original positions of the markers that passed."""
    return report.filter(F.col("reason").isNull()).join(markers.select("marker", "rsid"), "marker").select("rsid", "marker")
