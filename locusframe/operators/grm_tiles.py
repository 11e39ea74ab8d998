"""Relationship matrices as symmetric tile tables ``(rb, cb, k, n)``.

A row holds the values of ``TILE_ROWS`` by ``TILE_COLS`` pairs of individuals, eight bytes each, and only tiles that reach the lower triangle are
there; a value is NaN where one of the two isn't in the matrix or ``j > i``. ``n`` holds the marker counts of the pairs, or one number where
all have the same. Operators work tile by tile: only a merge of matrices moves them, and traces, norms and the sums of
variance models never turn a pair into a row. Long rows ``(i, j, k, n_snps)`` are an export.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.operators.tiles import ROWS, STRIPE, stored_order, tile_table, value_keys
from locusframe.session import materialise

TILE_ROWS, TILE_COLS = STRIPE, ROWS
HELD = 512
SCHEMA = "rb int, cb int, k binary, n binary"


def is_tiled(grm: DataFrame) -> bool:
    return "rb" in grm.columns


def lower(rb: int, cb: int) -> np.ndarray:
    """Which places of a tile belong to the lower triangle."""
    return (rb * TILE_ROWS + np.arange(TILE_ROWS))[:, None] >= (cb * TILE_COLS + np.arange(TILE_COLS))[None]


def values_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data).reshape(TILE_ROWS, TILE_COLS)


def counts_of(data: bytes) -> np.ndarray:
    """Marker counts of a tile, or one number for all of it."""
    return np.frombuffer(data) if len(data) == 8 else values_of(data)


def _batch(rb: list, cb: list, k: list, n: list) -> pa.RecordBatch:
    return pa.record_batch({"rb": pa.array(rb, pa.int32()), "cb": pa.array(cb, pa.int32()), "k": pa.array(k, pa.binary()), "n": pa.array(n, pa.binary())})


def tile_writer(value: Callable[[np.ndarray], np.ndarray], n_snps: float) -> Callable:
    """An ``emit`` for ``row_gram`` that packs finished blocks into tiles; ``value`` turns products into relationships."""
    count = np.array([n_snps]).tobytes()

    def emit(i: np.ndarray, j: np.ndarray, block: np.ndarray) -> pa.RecordBatch:
        rb = int(i[0]) // TILE_ROWS
        cbs, ks = [], []
        for cb in np.unique(j // TILE_COLS).tolist():
            own = j // TILE_COLS == cb
            tile = np.full((TILE_ROWS, TILE_COLS), np.nan)
            tile[np.ix_(i % TILE_ROWS, j[own] % TILE_COLS)] = value(block[:, own])
            tile[~lower(rb, cb)] = np.nan
            if not np.isnan(tile).all():
                cbs.append(cb)
                ks.append(tile.tobytes())
        return _batch([rb] * len(cbs), cbs, ks, [count] * len(cbs))

    return emit


def from_pairs(grm: DataFrame) -> DataFrame:
    """Tiles of a stored triangle ``(i, j, k, n_snps)``."""
    cells = grm.select(F.greatest("i", "j").alias("i"), F.least("i", "j").alias("j"), F.col("k").cast("double").alias("k"),
                       F.col("n_snps").cast("double").alias("n"))
    k, n = (tile_table(cells, "i", "j", c, TILE_ROWS, TILE_COLS).select("rb", "cb", F.col("x").alias(c)) for c in ("k", "n"))

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rb, cb, k, n = (c.to_pylist() for c in batch.columns)
            short = []
            for data in n:
                counts = np.frombuffer(data)
                known = counts[~np.isnan(counts)]
                short.append(known[:1].tobytes() if len(known) and (known == known[0]).all() else data)
            yield _batch(rb, cb, k, short)

    return k.join(n, ["rb", "cb"]).select("rb", "cb", "k", "n").mapInArrow(shorten, SCHEMA)


def pairs(tiles: DataFrame, digits: int | None = None) -> DataFrame:
    """Long rows ``(i, j, k, n_snps)``, ``j <= i``, of a tile table.

    Those of values that will be rounded to ``digits`` come in the order in which they take least storage (``stored_order``), ``HELD`` tiles at a time.
    """
    cells, bits = TILE_ROWS * TILE_COLS, (HELD * TILE_ROWS * TILE_COLS - 1).bit_length()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rb, cb, k, n in zip(*(c.to_pylist() for c in batch.columns)):
                k = values_of(k)
                at_i, at_j = np.nonzero(~np.isnan(k))
                counts = np.broadcast_to(counts_of(n), k.shape)
                yield pa.record_batch({"i": rb * TILE_ROWS + at_i, "j": cb * TILE_COLS + at_j, "k": k[at_i, at_j], "n_snps": counts[at_i, at_j]})

    def sent(values: np.ndarray, key: np.ndarray, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        rb, cb, counts = (np.array(x) for x in zip(*held))
        for places in stored_order(values.ravel(), key, bits, digits):
            tile, at = np.divmod(places, cells)
            at_i, at_j = np.divmod(at, TILE_COLS)
            yield pa.record_batch({"i": rb[tile] * TILE_ROWS + at_i, "j": cb[tile] * TILE_COLS + at_j, "k": values.ravel()[places], "n_snps": counts[tile]})

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, key, held, found = np.empty((HELD, cells)), np.empty(HELD * cells, np.int64), [], 0
        for batch in batches:
            for rb, cb, k, n in zip(*(c.to_pylist() for c in batch.columns)):
                if len(n) > 8:  # a count per pair
                    yield from unpack([_batch([rb], [cb], [k], [n])])
                    continue
                values[len(held)] = values_of(k).ravel()
                at = np.flatnonzero(~np.isnan(values[len(held)]))
                key[found:found + len(at)] = value_keys(values[len(held)][at], len(held) * cells + at, bits)
                found += len(at)
                held.append((rb, cb, counts_of(n)[0]))
                if len(held) == HELD:
                    yield from sent(values, key[:found], held)
                    held, found = [], 0
        if held:
            yield from sent(values, key[:found], held)

    return tiles.select("rb", "cb", "k", "n").mapInArrow(unpack if digits is None else in_order, "i long, j long, k double, n_snps double")


def tiled(grm: DataFrame) -> DataFrame:
    return grm if is_tiled(grm) else from_pairs(grm)


def each_value(tiles: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The matrix with a function of every value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rb, cb, k, n = (c.to_pylist() for c in batch.columns)
            yield _batch(rb, cb, [of(values_of(x)).tobytes() for x in k], n)

    return tiles.select("rb", "cb", "k", "n").mapInArrow(run, SCHEMA)


def power(tiles: DataFrame, exponent: int) -> DataFrame:
    """Element-wise power."""
    return each_value(tiles, lambda k: k**exponent)


def merge(grms: list[DataFrame]) -> DataFrame:
    """Average weighted by marker counts over the pairs that all matrices have; their tiles meet, and no pair does by itself."""
    many = len(grms)

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighted = total = 0.0
        seen = 0
        for batch in batches:
            for k, n in zip(batch.column("k").to_pylist(), batch.column("n").to_pylist()):
                weighted, total, seen = weighted + values_of(k) * counts_of(n), total + counts_of(n), seen + 1
        if seen == many and not np.isnan(weighted).all():
            yield _batch([key[0].as_py()], [key[1].as_py()], [(weighted / total).tobytes()], [np.ascontiguousarray(total).tobytes()])

    add.__annotations__ = {"key": tuple, "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return reduce(DataFrame.unionByName, [g.select("rb", "cb", "k", "n") for g in grms]).groupBy("rb", "cb").applyInArrow(add, SCHEMA)


def summed(tiles: DataFrame, of: Callable[[dict], np.ndarray], labels: list[str]) -> dict[str, float]:
    """Sums over all tiles of ``of(row)``, one number per label: added up in the tasks, one row per task and label."""
    names = tiles.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(labels))
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                total += of(dict(zip(names, row)))
        yield pa.record_batch({"label": pa.array(range(len(labels)), pa.int32()), "s": pa.array(total)})

    found = tiles.mapInArrow(run, "label int, s double").groupBy("label").agg(F.sum("s").alias("s")).collect()
    out = dict.fromkeys(labels, 0.0)
    for r in found:
        out[labels[r.label]] = r.s
    return out


def trace_stats(tiles: DataFrame) -> DataFrame:
    """``n``, ``trace`` and ``sum_sq`` (the squared Frobenius norm) of the full symmetric matrix."""

    def of(row: dict) -> np.ndarray:
        k = values_of(row["k"])
        diagonal = k[(row["rb"] * TILE_ROWS + np.arange(TILE_ROWS))[:, None] == (row["cb"] * TILE_COLS + np.arange(TILE_COLS))[None]]
        diagonal = diagonal[~np.isnan(diagonal)]
        return np.array([len(diagonal), diagonal.sum(), 2 * np.nansum(k * k) - diagonal @ diagonal])

    s = summed(tiles.select("rb", "cb", "k"), of, ["n", "trace", "sum_sq"])
    return tiles.sparkSession.createDataFrame([(int(s["n"]), s["trace"], s["sum_sq"])], "n long, trace double, sum_sq double")


def number_blocks(numbers: DataFrame, value: str, size: int) -> DataFrame:
    """A number per individual ``(iid, value)`` as blocks ``(block, v)`` of ``size``, NaN where there is none. They are stored, so that
    their true size decides how they are joined."""
    keyed = numbers.where(F.col(value).isNotNull()).select(
        F.expr(f"iid div {size}").cast("int").alias("block"), F.pmod("iid", F.lit(size)).cast("int").alias("at"), F.col(value).cast("double").alias("v"))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        out = np.full(size, np.nan)
        out[table.column("at").to_numpy()] = table.column("v").to_numpy()
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([out.tobytes()], pa.binary())})

    pack.__annotations__ = {"key": tuple, "table": pa.Table, "return": pa.Table}
    return materialise(keyed.groupBy("block").applyInArrow(pack, "block int, v binary"))


def beside(tiles: DataFrame, numbers: DataFrame, value: str) -> DataFrame:
    """Tiles with the numbers of their rows, ``vi``, and of their columns, ``vj``."""
    rows, cols = (number_blocks(numbers, value, size).withColumnsRenamed({"block": at, "v": name})
                  for size, at, name in ((TILE_ROWS, "rb", "vi"), (TILE_COLS, "cb", "vj")))
    return tiles.join(rows, "rb").join(cols, "cb")


def individuals(tiles: DataFrame) -> DataFrame:
    """Those in a matrix: ``iid`` of its diagonal."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rb, cb, k in zip(*(c.to_pylist() for c in batch.columns)):
                ids = rb * TILE_ROWS + np.arange(TILE_ROWS)
                ids = ids[ids // TILE_COLS == cb]
                known = ~np.isnan(values_of(k)[ids % TILE_ROWS, ids % TILE_COLS])
                yield pa.record_batch({"iid": ids[known].astype(np.int64)})

    diagonal = tiles.where(F.col("cb") == F.floor(F.col("rb") * TILE_ROWS / TILE_COLS))
    return diagonal.select("rb", "cb", "k").mapInArrow(unpack, "iid long")


def times(tiles: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """Product of the full symmetric matrix with ``width`` blocked vectors ``(block, v)`` of ``TILE_COLS`` values each; result ``(block, v)``.

    A tile adds to the block of its rows and, for the other triangle, to that of its columns. Tasks add up blocks before they send them.
    """
    per = TILE_COLS // TILE_ROWS
    stored = materialise(vectors)
    of_cols, of_rows = (stored.select(F.col("block").alias(at), F.col("v").alias(v)) for at, v in (("cb", "v"), ("_block", "u")))
    joined = tiles.select("rb", "cb", "k", F.floor(F.col("rb") / per).cast("int").alias("_block")).join(of_cols, "cb").join(of_rows, "_block")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}

        def sent() -> pa.RecordBatch:
            return pa.record_batch({"block": pa.array(list(sums), pa.int32()), "v": pa.array([x.ravel() for x in sums.values()], pa.list_(pa.float64()))})

        for batch in batches:
            for r in range(batch.num_rows):
                rb, cb = batch.column("rb")[r].as_py(), batch.column("cb")[r].as_py()
                k = np.nan_to_num(values_of(batch.column("k")[r].as_py()))
                v, u = (batch.column(c)[r].values.to_numpy().reshape(TILE_COLS, width) for c in ("v", "u"))
                first = rb % per * TILE_ROWS
                rows, cols = (sums.setdefault(b, np.zeros((TILE_COLS, width))) for b in (rb // per, cb))
                rows[first : first + TILE_ROWS] += k @ v
                strict = np.where((rb * TILE_ROWS + np.arange(TILE_ROWS))[:, None] == (cb * TILE_COLS + np.arange(TILE_COLS))[None], 0.0, k)
                cols += strict.T @ u[first : first + TILE_ROWS]
                if len(sums) > 256:
                    yield sent()
                    sums = {}
        yield sent()

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TILE_COLS * width)
        for batch in batches:
            for v in batch.column("v"):
                total += v.values.to_numpy()
        yield pa.record_batch({"block": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([total], pa.list_(pa.float64()))})

    add.__annotations__ = {"key": tuple, "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return joined.mapInArrow(multiply, "block int, v array<double>").groupBy("block").applyInArrow(add, "block int, v array<double>")
