"""Text sources: phenotypes, effects, weights, regions and id lists."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.functions.scalar import case_to_onehot, case_to_quantitative, h2_to_delta
from locusframe.operators.transform import scale_prior
from locusframe.sources.plink import indexed_lines


def _tokens(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path).filter(F.trim("value") != "").select(
        F.split(F.trim("value"), r"\s+").alias("t"), F.col("_metadata.file_name").alias("file"))


def read_pheno(spark: SparkSession, path: str, case_control: bool = False, recode: bool = True) -> DataFrame:
    """``(fid, iid_str, y)``; case/control status 1/2 becomes 0/1, or a two-column indicator array."""
    t, value = F.col("t"), F.col("t")[2].cast("float").cast("double")
    y = value if not case_control else case_to_quantitative(value) if recode else case_to_onehot(value)
    return _tokens(spark, path).select(t[0].alias("fid"), t[1].alias("iid_str"), y.alias("y"))


def by_position(pheno: DataFrame, samples: DataFrame) -> DataFrame:
    """Phenotypes keyed by sample position, joined on both ids."""
    return pheno.join(samples.select("iid", "fid", "iid_str"), ["fid", "iid_str"]).select("iid", "y")


def read_summary_stats(spark: SparkSession, path: str, scaled: bool = True) -> DataFrame:
    """``(rsid, beta[, scaled])`` from the first and third column; scaled = absolute value in 0..1."""
    raw = _tokens(spark, path).select(F.col("t")[0].alias("rsid"), F.col("t")[2].cast("double").alias("beta"))
    return scale_prior(raw) if scaled else raw


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """``(rsid, w)`` from a file with a header line."""
    lines = indexed_lines(spark, path).filter("line > 0").select(F.split(F.trim("value"), r"\s+").alias("t"))
    return lines.select(F.col("t")[0].alias("rsid"), F.col("t")[1].cast("double").alias("w"))


def _numbered_files(spark: SparkSession, pattern: str, number: str) -> DataFrame:
    """Lines of many files with the number in each file's name and the position in the file. A folder of parts counts as
    one file, its parts in the order of their names."""
    from locusframe.functions.ranking import with_row_index

    lines = spark.read.text(pattern).filter(F.trim("value") != "").select(
        F.split(F.trim("value"), r"\s+").alias("t"), F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_m"))
    lines = lines.withColumn("_no", F.regexp_extract("_file", f"/{number}(?:/part-[^/]*)?$", 1)).filter("_no <> ''")
    return with_row_index(lines.withColumn("file_no", F.col("_no").cast("int")), ["_m"], F.struct("_file", "_start"), by=("file_no",), name="row_no")


def read_region_members(spark: SparkSession, prefix: str) -> DataFrame:
    """``(region_id, rsid, position)`` from files ``region0`` (background) to ``regionN``; the count is in
    ``region_number``."""
    count = int(spark.read.text(prefix + "region_number").first()[0].strip())
    stem = re.escape(prefix.rsplit("/", 1)[-1])
    return _numbered_files(spark, prefix + "region[0-9]*", stem + r"region(\d+)").filter(F.col("file_no") <= count).select(
        F.col("file_no").alias("region_id"), F.col("t")[0].alias("rsid"), F.col("row_no").alias("position"))


def read_region_deltas(spark: SparkSession, path: str) -> DataFrame:
    """``(region_id, delta)`` from the heritability lines of a REML report, in file order."""
    lines = indexed_lines(spark, path).filter(F.col("value").contains("Her_"))
    from locusframe.functions.ranking import index_by_integer
    numbered = index_by_integer(lines, "line", "region_id")
    h2 = F.split(F.trim("value"), r"\s+")[1].cast("double")
    return numbered.select(F.col("region_id").cast("int").alias("region_id"), h2_to_delta(h2).alias("delta"))


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """``(row_no, start_idx, end_idx, delta)`` of one region file."""
    t = F.split(F.trim("value"), r"\s+")
    return indexed_lines(spark, path).select(
        F.col("line").alias("row_no"), t[0].cast("int").alias("start_idx"), t[1].cast("int").alias("end_idx"),
        t[2].cast("double").alias("delta"))


def read_region_files(spark: SparkSession, prefix: str) -> DataFrame:
    """Regions of ``<prefix>1.txt, <prefix>2.txt, ..`` up to the first missing number."""
    stem = prefix.rsplit("/", 1)[-1]
    rows = _numbered_files(spark, prefix + "*.txt", re.escape(stem) + r"(\d+)\.txt")
    numbers = {r.file_no for r in rows.select("file_no").distinct().collect()}
    last = next(k for k in range(1, len(numbers) + 2) if k not in numbers) - 1
    t = F.col("t")
    return rows.filter(F.col("file_no").between(1, last)).select(
        "file_no", "row_no", t[0].cast("int").alias("start_idx"), t[1].cast("int").alias("end_idx"),
        t[2].cast("double").alias("delta"))


def read_list(spark: SparkSession, path: str, name: str = "rsid", kind: str = "string") -> DataFrame:
    """First token of each line."""
    return _tokens(spark, path).select(F.col("t")[0].cast(kind).alias(name))


def read_effects(spark: SparkSession, path: str) -> DataFrame:
    """``(rsid, a1, beta)``, or ``(rsid, beta)`` for files with two columns."""
    t = F.col("t")
    three = F.size(t) > 2
    return _tokens(spark, path).select(
        t[0].alias("rsid"), F.when(three, t[1]).alias("a1"),
        F.when(three, F.get(t, F.lit(2))).otherwise(t[1]).cast("double").alias("beta"))
