"""Genotype-shaped tables derived with Spark from the star-schema parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.functions.scalar import h2_to_delta, observed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def geno(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense genotypes of 64 markers from the embeddings, with missing calls and markers that fail QC."""
    cells = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("iid"), F.posexplode("embedding").alias("marker", "v"))
    return cells.select("iid", "marker", F.expr("""
        cast(case when marker = 62 then 2
                  when marker = 63 then 0
                  when (iid * 31 + marker * 17) % 97 < marker % 8 then -1
                  when double(v) >= double(0.08) + (marker % 16) * double(0.022) then 2
                  when double(v) >= double(-0.05) + (marker % 16) * double(0.022) then 1
                  else 0 end as int)""").alias("dosage"))


def pheno(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partly heritable integer trait."""
    causal = geno(spark, sf_dir).filter("marker % 9 = 3").groupBy("iid").agg(F.sum(observed("dosage")).alias("g"))
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("iid"), "label")
    return labels.join(causal, "iid").select("iid", (F.col("label") + F.col("g")).cast("double").alias("y"))


def marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marker table; markers 40 and 41 share a name."""
    return table(spark, sf_dir, "embeddings").select(F.size("embedding").alias("p")).agg(F.max("p").alias("p")).select(
        F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("marker")).selectExpr(
        "marker", "string(1 + marker div 16) as chrom",
        "case when marker in (40, 41) then 'rs_dup' else concat('rs', 1000 + marker) end as rsid",
        "double(0) as cm", "bigint(1000 * (marker + 1)) as pos", "'A' as a1", "'C' as a2")


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pheno(spark, sf_dir).selectExpr(
        "iid", "concat('F', iid) as fid", "concat('I', iid) as iid_str", "'0' as father", "'0' as mother",
        "0 as gender", "double(1 + int(y > 6)) as status")


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted alleles of every marker over all individuals."""
    return geno(spark, sf_dir).groupBy("marker").agg(F.sum(observed("dosage")).cast("long").alias("g"))


def effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One effect per marker, from its allele count; names are unique so that a join by rsid is one to one."""
    return marker(spark, sf_dir).join(_copies(spark, sf_dir), "marker").selectExpr(
        "marker", "concat('rs', 1000 + marker) as rsid", "if(marker % 5 = 0, 'C', 'A') as a1", "((g + marker * 37) % 11 - 5) / double(10) as beta")


def weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marker(spark, sf_dir).selectExpr(
        "marker", "rsid", "if(marker % 13 = 0, double(0), 1 + marker / double(64)) as w")


def region_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions 0 to 3 by allele count, in the order of markers."""
    return marker(spark, sf_dir).join(_copies(spark, sf_dir), "marker").selectExpr(
        "g % 4 as region_id", "concat('rs', 1000 + marker) as rsid", "marker", "marker as position")


def region_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heritability of each region by its number of markers."""
    sized = region_member(spark, sf_dir).groupBy("region_id").agg(F.count(F.lit(1)).alias("n"))
    h2 = F.expr("element_at(array(double(0), double(0.1), double(0.2), double(0.5)), int((n + region_id) % 4) + 1)")
    return sized.select("region_id", h2.alias("h2")).select("region_id", h2_to_delta("h2").alias("delta"))


def sparse_geno(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large sparse genotypes from the order lines: absent pairs are 0."""
    return table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_orderkey").alias("iid"), (F.col("l_partkey") % 128).cast("int").alias("marker")).agg(
        F.least(F.lit(2), F.count(F.lit(1))).cast("int").alias("dosage"))


def sparse_pheno(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("iid"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("y"))


def sparse_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One effect per marker of the sparse genotypes, from its number of order lines."""
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 128).cast("int").alias("marker")).agg(
        F.count(F.lit(1)).alias("n")).selectExpr("marker", "(n % 11 - 5) / double(10) as beta")


def named_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as markers that are named by their brand, so that names repeat."""
    return table(spark, sf_dir, "part").selectExpr("cast(p_partkey as int) as marker", "p_brand as rsid")


def part_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A marker per part, in the order of parts: chromosome by size, position by key, alleles by type and name."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey as marker", "cast(1 + p_size % 22 as string) as chrom", "concat('rs', p_partkey) as rsid", "p_size / double(8) as cm",
        "bigint(p_partkey * 100 + p_size) as pos", "substr(p_type, 1, 1) as a1", "substr(p_name, 1, 1) as a2")


def count_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weight per part from its number of order lines."""
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).selectExpr(
        "l_partkey as marker", "concat('rs', l_partkey) as rsid", "n / double(4) as w")


def layer_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A network of one hidden layer of 8 neurons over all markers, without biases, from allele counts of eight groups of people."""
    counts = geno(spark, sf_dir).groupBy("marker", (F.col("iid") % 8).cast("int").alias("j")).agg(F.sum(observed("dosage")).cast("long").alias("g"))
    first = counts.selectExpr("0 as layer", "marker as i", "j", "(g % 11 - 5) / double(40) as w")
    second = counts.groupBy("j").agg(F.sum("g").alias("g")).selectExpr("1 as layer", "j as i", "0 as j", "(g % 7 - 3) / double(5) as w")
    return first.unionByName(second)


def covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two covariates per individual in long form."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("iid"), F.expr("explode(map(0, double(label), 1, double(vec_id % 7)))").alias("cov", "value"))


def region_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region lists of the four chromosomes: blocks of 8 markers every 4, ends exclusive."""
    chroms = _copies(spark, sf_dir).selectExpr("marker div 16 as file_no", "g").groupBy("file_no").agg(
        F.count(F.lit(1)).alias("count"), F.sum("g").alias("g"))
    return chroms.selectExpr("int(file_no) as file_no", "count", "g", "explode(sequence(0, 2)) as row_no").selectExpr(
        "file_no", "row_no", "4 * row_no as start_idx", "int(least(4 * row_no + 8, count)) as end_idx",
        "g % 10 + row_no / double(10) as delta")
