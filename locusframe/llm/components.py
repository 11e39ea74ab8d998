"""Connected components of a distributed edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import materialise
from locusframe.session import discard

MAX_ROUNDS = 64


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang the larger neighbours of every node on the smallest node among it and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang every node and its smaller neighbours on the smallest of them. Edges run from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    inner = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).unionByName(inner).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node that has an edge ``a, b`` (of one type); the root is the component's smallest node.

    Repeated edges, loops and edges with nulls change nothing. Every round is written to the shared folder, so that neither
    lineage nor a lost executor repeats earlier rounds; only the sums that tell whether a round changed anything
    reach the driver.
    """
    clean = edges.where("a is not null and b is not null and a <> b")
    stars = materialise(clean.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(MAX_ROUNDS):
        before, stars = stars, materialise(_small_star(_large_star(stars)))
        discard(before)
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    leaves = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
