"""Positive definite systems of any size: blocked Cholesky factors as tile tables.

A symmetric matrix is a table of square blocks ``(bi, bj, x)`` of its lower triangle. The factor is found a block column at a time: the products
of earlier columns with their blocks in the current row are summed per block row, the diagonal block is factored on the driver, and the
column below it is solved in the tasks. Block forward substitution of the identity gives the inverse of the factor a block row
at a time, from which follow solutions and the diagonal of the inverse. Only single blocks and sums reach the driver; columns and rows that are done are
stored, so a lost executor costs part of one step.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.operators.tiles import STRIPE, row_gram
from locusframe.session import materialise

SIDE = 512
SCHEMA = "bi int, bj int, x binary"


def _rows(keys: list[tuple[int, int]], blocks: list[np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch({"bi": pa.array([k[0] for k in keys], pa.int32()), "bj": pa.array([k[1] for k in keys], pa.int32()),
                            "x": pa.array([np.ascontiguousarray(b).tobytes() for b in blocks], pa.binary())})


def _summed(parts: DataFrame, side: int) -> DataFrame:
    """The sum of the blocks of each place."""

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((side, side))
        for batch in batches:
            for x in batch.column("x"):
                total += np.frombuffer(x.as_buffer()).reshape(side, side)
        yield _rows([(key[0].as_py(), key[1].as_py())], [total])

    add.__annotations__ = {"key": tuple, "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return parts.groupBy("bi", "bj").applyInArrow(add, SCHEMA)


def gram_blocks(tiles: DataFrame, rows: int, cols: int, side: int = SIDE) -> DataFrame:
    """``X X'`` of a stored tile table, whose rows are numbered densely, as blocks of the lower triangle. A block is written where it is computed, in
    stripes; ``side`` is a multiple of ``STRIPE``, or all rows fit one stripe."""
    height = min(STRIPE, side)

    def emit(i: np.ndarray, j: np.ndarray, block: np.ndarray) -> pa.RecordBatch:
        out: dict[str, list] = {"bi": [], "bj": [], "at": [], "x": []}
        for at in np.unique(i // height).tolist():
            own_i = i // height == at
            for bj in np.unique(j // side).tolist():
                if bj * side > i[own_i][-1]:
                    continue
                own_j = j // side == bj
                stripe = np.zeros((height, side))
                stripe[np.ix_(i[own_i] % height, j[own_j] % side)] = block[np.ix_(own_i, own_j)]
                out["bi"].append(at * height // side)
                out["bj"].append(bj)
                out["at"].append(at * height % side)
                out["x"].append(stripe.tobytes())
        return pa.record_batch({c: pa.array(out[c], pa.binary() if c == "x" else pa.int32()) for c in out})

    def assemble(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = np.zeros((side, side))
        for batch in batches:
            for at, x in zip(batch.column("at").to_pylist(), batch.column("x")):
                block[at : at + height] += np.frombuffer(x.as_buffer()).reshape(height, side)
        yield _rows([(key[0].as_py(), key[1].as_py())], [block])

    assemble.__annotations__ = {"key": tuple, "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    stripes = row_gram(tiles, rows, cols, emit=emit, schema="bi int, bj int, at int, x binary")
    return stripes.groupBy("bi", "bj").applyInArrow(assemble, SCHEMA)


def _products(left: DataFrame, right: DataFrame, on: str, key: tuple[str, str], transpose: bool, side: int) -> DataFrame:
    """Sums of ``-x @ y`` (or of ``-x @ y'``) over the pairs of blocks that meet on a column, per place ``key``; tasks add up before they send."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in (*key, "x", "y"))):
                x, y = np.frombuffer(x).reshape(side, side), np.frombuffer(y).reshape(side, side)
                out = -(x @ (y.T if transpose else y))
                sums[a, b] = sums[a, b] + out if (a, b) in sums else out
                if len(sums) * out.nbytes > 64 << 20:
                    yield _rows(list(sums), list(sums.values()))
                    sums = {}
        yield _rows(list(sums), list(sums.values()))

    return left.join(right, on).mapInArrow(multiply, SCHEMA)


def _one(table: DataFrame, i: int, j: int, side: int) -> np.ndarray:
    return np.frombuffer(table.where((F.col("bi") == i) & (F.col("bj") == j)).select("x").first()[0]).reshape(side, side)


def _mapped(table: DataFrame, of, side: int) -> DataFrame:
    """Every block as a function of its place and values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bi, bj = batch.column("bi").to_pylist(), batch.column("bj").to_pylist()
            yield _rows(list(zip(bi, bj)), [of(i, j, np.frombuffer(x.as_buffer()).reshape(side, side)) for i, j, x in zip(bi, bj, batch.column("x"))])

    return table.select("bi", "bj", "x").mapInArrow(run, SCHEMA)


def factor(blocks: DataFrame, n: int, shift: float = 0.0, side: int = SIDE) -> DataFrame:
    """Lower factor of the ``n`` by ``n`` matrix plus ``shift`` on its diagonal. Places beyond ``n`` get a diagonal of ones. Raises where the matrix
    isn't positive definite."""
    many = -(-n // side)
    done: list[DataFrame] = []
    for k in range(many):
        column = blocks.where(F.col("bj") == k)
        if done:
            earlier = reduce(DataFrame.unionByName, done)
            row = earlier.where(F.col("bi") == k).select(F.col("bi").alias("bk"), F.col("bj"), F.col("x").alias("y"))
            parts = _products(earlier.where(F.col("bi") >= k), row, "bj", ("bi", "bk"), True, side)
            column = column.unionByName(parts)
        current = materialise(_summed(column, side))
        diagonal = np.tril(_one(current, k, k, side))
        diagonal = diagonal + np.tril(diagonal, -1).T + shift * np.eye(side)
        beyond = np.arange(side) + k * side >= n
        diagonal[beyond, beyond] = 1.0
        head = np.linalg.cholesky(diagonal)
        inverse = np.linalg.inv(head)
        done.append(materialise(_mapped(current, lambda i, j, x: head if i == j else x @ inverse.T, side)))  # noqa: B023 (run at once)
    return reduce(DataFrame.unionByName, done)


def inverse_factor(lower: DataFrame, n: int, side: int = SIDE) -> DataFrame:
    """The inverse of a lower factor, as blocks of its lower triangle."""
    done: list[DataFrame] = []
    for i in range(-(-n // side)):
        head = np.linalg.inv(_one(lower, i, i, side))
        spark = lower.sparkSession
        own = spark.createDataFrame([(i, i, np.eye(side).tobytes())], SCHEMA)
        if done:
            above = reduce(DataFrame.unionByName, done).select(F.col("bi").alias("_j"), F.col("bj").alias("bk"), F.col("x").alias("y"))
            row = lower.where((F.col("bi") == i) & (F.col("bj") < i)).select("bi", F.col("bj").alias("_j"), "x")
            own = own.unionByName(_summed(_products(row, above, "_j", ("bi", "bk"), False, side), side))
        done.append(materialise(_mapped(own, lambda a, b, x: head @ x, side)))  # noqa: B023 (run at once)
    return reduce(DataFrame.unionByName, done)


def _times(inverse: DataFrame, vector: DataFrame, side: int, transpose: bool) -> DataFrame:
    """Product of the block table (or its transpose) with a blocked vector ``(block, v)``."""
    near, far = ("bi", "bj") if transpose else ("bj", "bi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(x.T if transpose else x) @ v.values.to_numpy() for x, v in (
                (np.frombuffer(x.as_buffer()).reshape(side, side), v) for x, v in zip(batch.column("x"), batch.column("v")))]
            yield pa.record_batch({"block": batch.column(far), "v": pa.array(out, pa.list_(pa.float64()))})

    parts = inverse.join(vector.withColumnRenamed("block", near), near).select(far, "x", "v").mapInArrow(run, "block int, v array<double>")

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(side)
        for batch in batches:
            for v in batch.column("v"):
                total += v.values.to_numpy()
        yield pa.record_batch({"block": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([total], pa.list_(pa.float64()))})

    add.__annotations__ = {"key": tuple, "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return parts.groupBy("block").applyInArrow(add, "block int, v array<double>")


def solve(blocks: DataFrame, right: DataFrame, n: int, shift: float = 0.0, side: int = SIDE) -> DataFrame:
    """``idx, beta, inverse``: the solution of ``(A + shift I) beta = right`` and the diagonal of the inverse.

    ``right(idx, v)`` are the values of the right side, 0 where there is none.
    """
    keyed = right.select(F.expr(f"idx div {side}").cast("int").alias("block"), F.pmod("idx", F.lit(side)).cast("int").alias("at"),
                         F.col("v").cast("double").alias("v"))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        out = np.zeros(side)
        out[table.column("at").to_numpy()] = table.column("v").to_numpy()
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([out], pa.list_(pa.float64()))})

    pack.__annotations__ = {"key": tuple, "table": pa.Table, "return": pa.Table}
    inverse = inverse_factor(factor(blocks, n, shift, side), n, side)
    vector = materialise(keyed.groupBy("block").applyInArrow(pack, "block int, v array<double>"))
    half = materialise(_times(inverse, vector, side, transpose=False))
    beta = _times(inverse, half, side, transpose=True)

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.square(np.frombuffer(x.as_buffer()).reshape(side, side)).sum(0) for x in batch.column("x")]
            yield pa.record_batch({"block": batch.column("bj"), "q": pa.array(found, pa.list_(pa.float64()))})

    diagonal = inverse.select("bj", "x").mapInArrow(squares, "block int, q array<double>").select(
        "block", F.posexplode("q").alias("at", "q")).groupBy("block", "at").agg(F.sum("q").alias("inverse"))
    idx = F.col("block").cast("long") * side + F.col("at")
    values = beta.select("block", F.posexplode("v").alias("at", "beta")).select(idx.alias("idx"), "beta")
    return values.join(diagonal.select(idx.alias("idx"), "inverse"), "idx").where(F.col("idx") < n)
