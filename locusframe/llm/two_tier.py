"""Sums over a document's items of values that a table as large as the corpus's distinct items holds.

Items that make up at least a share ``1 / limit`` of all occurrences are at most ``limit`` by definition: they are broadcast and added up
where the documents are read. All other items are rare, so no key of their join is hot; they travel once, one row per document and
distinct item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frequent(values: DataFrame, count: str, limit: int):
    """The condition that an item belongs to the first tier, and its threshold."""
    total = values.agg(F.sum(count).alias("n")).first().n or 0
    least = max(1, -(-total // limit))
    return F.col(count) >= least, least


def sums_by_row(parts: DataFrame, values: DataFrame, columns: list[str], own: list[str] = []) -> DataFrame:
    """``row``, the columns ``own`` and the sums of ``columns``: what ``parts`` bring themselves plus ``n`` times the values of their keys.

    ``parts`` has rows ``row, key, n`` and all these columns, which are null in rows of rare items. The row of a document's first tier has a key of its
    own that no item has, so that such rows spread over the partitions of the join.
    """
    table = values.select("key", *(F.col(c).alias(f"_{c}") for c in columns))
    joined = parts.join(table, "key", "left")
    return joined.groupBy("row").agg(*(F.sum(F.coalesce(F.col(c), F.col("n") * F.col(f"_{c}"))).alias(c) for c in columns), *(F.max(c).alias(c) for c in own))
