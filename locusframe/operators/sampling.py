"""Bootstrap oversampling of cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.functions.ranking import hash_fraction, index_by_integer
from locusframe.operators.align import split_cases


def oversample_plan(samples: DataFrame, case_ids: DataFrame, seed: int) -> DataFrame:
    """``(row_id, iid, is_case)``: every non-case once, then as many cases drawn with replacement.

    A draw is a seeded hash of its number, so it is uniform, repeatable and independent of
    partitioning. Draws and cases meet in an equi-join on the case's position; the hash spreads
    draws evenly over cases, so there is no hot key.
    """
    cases, others = split_cases(samples, case_ids)
    n_cases, n_others = cases.count(), others.count()
    spark = samples.sparkSession
    controls = index_by_integer(others.select("iid"), "iid").select(
        F.col("idx").alias("row_id"), "iid", F.lit(False).alias("is_case"))
    if n_cases == 0:
        return controls
    draws = spark.range(n_others).select(
        (F.col("id") + n_others).alias("row_id"),
        (hash_fraction(F.col("id"), seed) % n_cases).alias("idx"))
    drawn = draws.join(index_by_integer(cases.select("iid"), "iid"), "idx").select(
        "row_id", "iid", F.lit(True).alias("is_case"))
    return controls.unionByName(drawn)


def oversample(table: DataFrame, plan: DataFrame, copies_per_task: int = 256) -> DataFrame:
    """Repeat the rows of ``table(iid, ..)`` as the plan says; ``row_id`` tells copies apart.

    With few cases each one is drawn very often. Its draws are then spread over several keys
    ``(iid, salt)`` and its rows are sent once to each, so no task writes all copies of one case.
    """
    drawn = plan.groupBy("is_case").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("iid").alias("ids"))
    per_id = max((r.n / max(r.ids, 1) for r in drawn.collect()), default=1.0)
    salts = max(1, min(4096, round(per_id / copies_per_task)))
    if salts == 1:
        return plan.join(table, "iid")
    salted = plan.withColumn("_salt", F.when(F.col("is_case"), F.pmod("row_id", F.lit(salts))).otherwise(0).cast("int"))
    cases = plan.filter("is_case").select("iid").distinct().withColumn("_last", F.lit(salts - 1))
    spread = table.join(cases, "iid", "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_last", F.lit(0))))).drop("_last")
    return salted.join(spread, ["iid", "_salt"]).drop("_salt")
