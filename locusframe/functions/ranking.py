"""Dense row numbers without pulling the whole table into one task.

A plain ``row_number() over (order by ..)`` sorts everything in a single partition, and one over
``partition by key`` sorts a hot key in a single partition. Here rows get a bucket of bounded
size first: the rank is the rank inside the bucket plus the number of rows in earlier buckets,
so the only unpartitioned window runs over one row per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 4096


def with_row_index(df: DataFrame, order: list[str], bucket: Column, by: tuple[str, ...] = (),
                   name: str = "idx") -> DataFrame:
    """Add the 0-based position ``name`` of each row in ``order``, restarting per ``by`` group.

    ``bucket`` must grow (weakly) with ``order``.
    """
    tagged = df.withColumn("_bucket", bucket)
    keys = [*by, "_bucket"]
    sizes = tagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    return (
        tagged.withColumn("_local", F.row_number().over(inside) - 1)
        .join(offsets, keys)
        .withColumn(name, (F.col("_local") + F.col("_before")).cast("long"))
        .drop("_bucket", "_local", "_before")
    )


def index_by_integer(df: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """Dense position in the order of a unique integer key."""
    return with_row_index(df, [key], F.floor(F.col(key) / SPAN), name=name)


def hash_order(key: str, seed: int) -> Column:
    """Seeded pseudo-random order of rows: the hexadecimal md5 of ``seed:key``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def hash_fraction(key: Column, seed: int) -> Column:
    """32 bit unsigned integer from the md5 of ``seed:key``."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def index_by_hash(df: DataFrame, key: str, seed: int, name: str = "idx") -> DataFrame:
    """Position in a seeded random permutation; buckets are the leading hash digits, as many as keep a bucket to about ``SPAN`` rows."""
    rows, digits = df.count(), 1
    while rows > SPAN * 16**digits:
        digits += 1
    return with_row_index(
        df.withColumn("_h", hash_order(key, seed)), ["_h", key],
        F.conv(F.substring("_h", 1, digits), 16, 10).cast("long"), name=name,
    ).drop("_h")
