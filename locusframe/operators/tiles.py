"""Blocked matrices as tables: one row per tile of genotypes, and products of such tables.

A tile holds ``ROWS x COLS`` cells as one byte per genotype. Its size is fixed by the block
numbers ``row div ROWS`` and ``col div COLS``, so no tile, and no group built here, grows with the
data or with how often a key occurs. A tile row also carries what its columns need to be
standardised (mean and 1/sd), so z-scores are never shuffled.

The product of a table with itself works on pairs of super-blocks (up to ``SUPER`` row blocks
each): tiles of a pair arrive sorted by column block and are multiplied as they stream by, so a task
holds one accumulator and the tiles of one column block, however many columns there are. Larger
super-blocks mean fewer copies of each tile: n rows cost ``n / (SUPER * ROWS)`` copies of one byte
per genotype. Columns are cut into slabs only when there are too few pairs to keep the cluster
busy. The n x n result is what a relationship matrix is; the unit of work and of shuffle is a pair
of blocks, not a pair of individuals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.session import materialise

ROWS = 512
COLS = 1024
SUPER = 8
STRIPE = 64
MAX_TASKS = 1 << 15
ABSENT = -128
#: A column chunk of Parquet holds at most so many distinct doubles in its dictionary (1 MB); with more, a value takes its eight bytes.
DICTIONARY = 1 << 17
BATCH = 1 << 18

FRAGMENT_CELLS = 1 << 21


def fragments(keyed: DataFrame) -> DataFrame:
    """Cells ``(rb, cb, pos, v)`` packed per task into runs of one tile: ``(rb, cb, pos, v)`` with binaries.

    Five bytes per cell (twelve for doubles) are shuffled instead of a row, and nothing is sorted cell
    by cell in the shuffle. A task holds ``FRAGMENT_CELLS`` cells at a time. On the way to Python a
    genotype cell is one long, since that transfer costs by the field.
    """
    whole = dict(keyed.dtypes)["v"] == "tinyint"
    kind = np.int8 if whole else np.float64
    rb, cb, pos = F.col("rb").cast("long"), F.col("cb").cast("long"), F.col("pos").cast("long")
    code = F.shiftleft(rb, 44).bitwiseOR(F.shiftleft(cb, 24)).bitwiseOR(F.shiftleft(pos, 3))
    fits = (rb >= 0) & (rb < 1 << 19) & (cb >= 0) & (cb < 1 << 20) & (pos < 1 << 21)
    if whole:
        fits = fits & F.col("v").between(-1, 6)
        code = code.bitwiseOR((F.col("v") + 1).cast("long"))
    code = F.when(fits, code).otherwise(F.raise_error(F.lit("cell outside the range of tiles")).cast("long"))
    sent = keyed.select(code.alias("k"), *([] if whole else [F.col("v")]))

    def binary(data: np.ndarray, starts: np.ndarray) -> pa.Array:
        offsets = (np.append(starts, len(data)) * data.itemsize).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])

    def pack(held):
        table = pa.Table.from_batches(held)
        codes = table.column("k").to_numpy()
        key, pos = codes >> 24, ((codes >> 3) & 0x1FFFFF).astype(np.int32)
        v = ((codes & 7) - 1).astype(np.int8) if whole else table.column("v").to_numpy()
        if np.any(key[1:] < key[:-1]):
            order = np.argsort(key, kind="stable")
            key, pos, v = key[order], pos[order], v[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        return pa.record_batch({
            "rb": pa.array((key[starts] >> 20).astype(np.int32)), "cb": pa.array((key[starts] & 0xFFFFF).astype(np.int32)),
            "pos": binary(pos, starts), "v": binary(v, starts)})

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= FRAGMENT_CELLS:
                yield pack(held)
                held, size = [], 0
        if held:
            yield pack(held)

    return sent.mapInArrow(run, "rb int, cb int, pos binary, v binary")


def fill_tile(table: pa.Table, tile: np.ndarray) -> np.ndarray:
    """Write the fragments of one tile into a flat array."""
    for pos, v in zip(table.column("pos"), table.column("v")):
        tile[np.frombuffer(pos.as_buffer(), np.int32)] = np.frombuffer(v.as_buffer(), tile.dtype)
    return tile


def stat_blocks(stats: DataFrame, col: str, cols: int) -> DataFrame:
    """Mean and 1/sd per column in blocks ``(cb, mu, inv)``; a group is one block."""
    keyed = stats.select(
        F.floor(F.col(col) / cols).cast("int").alias("cb"), F.pmod(F.col(col), F.lit(cols)).cast("int").alias("at"),
        F.col("mean").cast("double").alias("mean"), F.col("sd").cast("double").alias("sd"))

    def pack(key, table):
        mu, inv, at = np.zeros(cols), np.zeros(cols), table.column("at").to_numpy()
        mu[at] = table.column("mean").to_numpy()
        inv[at] = 1.0 / table.column("sd").to_numpy()
        return pa.table({"cb": pa.array([key[0].as_py()], pa.int32()), "mu": pa.array([mu.tobytes()], pa.binary()),
                         "inv": pa.array([inv.tobytes()], pa.binary())})

    return keyed.groupBy("cb").applyInArrow(pack, "cb int, mu binary, inv binary")


def tile_table(cells: DataFrame, row: str, col: str, value: str, rows: int = ROWS, cols: int = COLS,
               stats: DataFrame | None = None) -> DataFrame:
    """Pack long cells into tiles ``(rb, cb, x, mu, inv)``.

    Integer values become one byte, others eight. ``stats(col, mean, sd)`` go along per block of
    columns. The cells are shuffled once, packed; everything after works on tiles.
    """
    integral = dict(cells.dtypes)[value] in ("tinyint", "smallint", "int")
    kind, fill = (np.int8, ABSENT) if integral else (np.float64, np.nan)
    r, c = F.col(row).cast("long"), F.col(col).cast("long")
    keyed = cells.select(
        F.expr(f"`{row}` div {rows}").alias("rb"), F.expr(f"`{col}` div {cols}").alias("cb"),
        (r % rows * cols + c % cols).alias("pos"), F.col(value).cast("tinyint" if integral else "double").alias("v"))

    def assemble(key, table):
        x = fill_tile(table, np.full(rows * cols, fill, kind))
        return pa.table({"rb": pa.array([key[0].as_py()], pa.int32()), "cb": pa.array([key[1].as_py()], pa.int32()),
                         "x": pa.array([x.tobytes()], pa.binary())})

    tiles = fragments(keyed).groupBy("rb", "cb").applyInArrow(assemble, "rb int, cb int, x binary")
    if stats is None:
        none = F.lit(None).cast("binary")
        return tiles.withColumn("mu", none).withColumn("inv", none)
    return with_stats(tiles, stats, col, cols)


def with_stats(tiles: DataFrame, stats: DataFrame, col: str = "marker", cols: int = COLS) -> DataFrame:
    """Tiles whose columns are standardised by ``stats``; columns without statistics (for instance
    markers that failed QC) count as 0 everywhere."""
    blocks = materialise(stat_blocks(stats, col, cols))
    return tiles.select("rb", "cb", "x").join(blocks, "cb").select("rb", "cb", "x", "mu", "inv")


def with_side(tiles: DataFrame, numbers: DataFrame, row: str, value: str, rows: int = ROWS) -> DataFrame:
    """Tiles with one number per row, as a column ``side`` of blocks; rows without a number have 0."""
    keyed = numbers.select(F.expr(f"`{row}` div {rows}").cast("int").alias("rb"), F.pmod(F.col(row), F.lit(rows)).cast("int").alias("at"),
                           F.col(value).cast("double").alias("v"))

    def pack(key, table):
        side = np.zeros(rows)
        side[table.column("at").to_numpy()] = table.column("v").to_numpy()
        return pa.table({"rb": pa.array([key[0].as_py()], pa.int32()), "side": pa.array([side.tobytes()], pa.binary())})

    blocks = materialise(keyed.groupBy("rb").applyInArrow(pack, "rb int, side binary"))
    return tiles.join(blocks, "rb").select(*tiles.columns, "side")


def decode(x: bytes, mu: bytes | None, inv: bytes | None, rows: int, cols: int, narrow: bool = False):
    """Tile values as doubles (absent cells 0, missing calls 0 copies) and the present rows and columns.

    With ``narrow`` the values have only those columns that have statistics: the others are 0 everywhere.
    """
    kind = np.int8 if len(x) == rows * cols else np.float64
    raw = np.frombuffer(x, kind).reshape(rows, cols)
    absent = raw == ABSENT if kind is np.int8 else np.isnan(raw)
    present = ~absent.all(axis=1), ~absent.all(axis=0)
    shift, scale = (None, None) if mu is None else (np.frombuffer(mu), np.frombuffer(inv))
    if narrow and scale is not None:
        used = np.flatnonzero(scale)
        raw, absent, shift, scale = raw[:, used], absent[:, used], shift[used], scale[used]
    values = raw.astype(np.float64)
    if kind is np.int8:
        np.maximum(values, 0.0, out=values)
    if shift is not None:
        values = (values - shift) * scale
    values[absent] = 0.0
    return values, *present


def fitting_cols(stats: DataFrame, col: str, most: int = COLS) -> int:
    """Columns of a tile wide enough for all positions of stored ``stats``, a power of two and ``most`` at most: tiles of a few columns would be padding else."""
    top = stats.agg(F.max(col)).first()[0]
    return most if top is None or top < 0 else min(most, 1 << int(top).bit_length())


def block_counts(tiles: DataFrame) -> tuple[int, int]:
    """Numbers of row and column blocks (reads two integer columns)."""
    top = tiles.agg(F.max("rb"), F.max("cb")).first()
    return (0, 0) if top[0] is None else (top[0] + 1, top[1] + 1)


class _PairProduct:
    """Running product of two super-blocks while their tiles stream by in column order."""

    def __init__(self, hi: int, lo: int, span: int, rows: int, cols: int, parts: int = 1):
        self.hi, self.lo, self.span, self.rows, self.cols = hi, lo, span, rows, cols
        size = span * rows
        self.acc = np.zeros((parts, size, size))
        self.norm = {hi: np.zeros(size), lo: np.zeros(size)}
        self.seen = {hi: np.zeros(size, bool), lo: np.zeros(size, bool)}
        self.side = {hi: np.zeros(size), lo: np.zeros(size)}
        self.at, self.tiles = None, {}

    def take(self, part, cb, rb, x, mu, inv, side=None):
        if (part, cb) != self.at:
            self.fold()
            self.at = (part, cb)
        values, present, _ = decode(x, mu, inv, self.rows, self.cols, narrow=True)
        block, at = rb // self.span, (rb % self.span) * self.rows
        self.tiles[(block, at)] = values
        self.norm[block][at:at + self.rows] += np.einsum("ij,ij->i", values, values)
        self.seen[block][at:at + self.rows] |= present
        if side is not None:
            self.side[block][at:at + self.rows] = np.frombuffer(side)

    def fold(self):
        r = self.rows
        for (block, at), left in self.tiles.items():
            if block != self.hi:
                continue
            for (other, to), right in self.tiles.items():
                if other == self.lo and (self.hi != self.lo or to <= at):
                    self.acc[self.at[0], at:at + r, to:to + r] += left @ right.T
        self.tiles = {}

    def stripes(self, distance: bool):
        """(first row, values, rows present, columns present, numbers of rows, of columns) of every stripe with a present row."""
        self.fold()
        hi, lo = self.hi, self.lo
        for first in range(0, self.acc.shape[1], STRIPE):
            rows = slice(first, first + STRIPE)
            if self.seen[hi][rows].any():
                block = self.acc[:, rows]
                if distance:
                    block = self.norm[hi][rows, None] + self.norm[lo][None] - 2.0 * block
                yield first, block, self.seen[hi][rows], self.seen[lo], self.side[hi][rows], self.side[lo]


def lower_pairs(i: np.ndarray, j: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of the lower triangle of a block; ``i`` and ``j`` rise. Columns come in runs of ``ROWS``: a table finds the repeats of these
    when it is compressed, those of longer runs lie too far apart."""
    found = []
    for at in range(0, max(len(j), 1), ROWS):
        some, values = j[at:at + ROWS], block[:, at:at + ROWS]
        if len(some) and some[-1] <= i[0]:
            found.append((np.repeat(i, len(some)), np.tile(some, len(i)), values.ravel()))
        else:
            at_i, at_j = np.nonzero(some[None] <= i[:, None])
            found.append((i[at_i], some[at_j], values[at_i, at_j]))
    return tuple(map(np.concatenate, zip(*found)))


def value_keys(values: np.ndarray, places: np.ndarray, bits: int) -> np.ndarray:
    """Integers that rise with ``values``, but for their last ``bits``, which hold the values' places."""
    key = np.ascontiguousarray(values).view(np.int64)
    return (key ^ (key >> 63 & np.iinfo(np.int64).max)) >> bits << bits | places


def stored_order(values: np.ndarray, key: np.ndarray, bits: int, digits: int) -> Iterator[np.ndarray]:
    """The places in ``key`` (of ``value_keys``, sorted here), batch by batch, in the order in which a table of ``values`` rounded to ``digits`` is small.

    That is by value where most values repeat and are too many for a dictionary: a run of equal ones takes little. Else the places rise.
    """
    key.sort()
    key &= (1 << bits) - 1
    batches = [slice(at, at + BATCH) for at in range(0, len(key), BATCH)]
    distinct, last = 0, np.nan
    for at in batches:
        rounded = np.rint(values[key[at]] * 10.0**digits)
        distinct += np.count_nonzero(np.diff(rounded, prepend=last))
        last = rounded[-1]
    if not DICTIONARY < distinct < len(key) / 3:
        key.sort()
    yield from (key[at] for at in batches)


def pair_rows(i: np.ndarray, j: np.ndarray, block: np.ndarray) -> pa.RecordBatch:
    """A block of results as long rows of its lower triangle."""
    return pa.record_batch(dict(zip(("i", "j", "s"), lower_pairs(i, j, block))))


def stacked(tables: list[DataFrame]) -> DataFrame:
    """Several tile tables over the same rows as one, with their number in a column ``part``."""
    whole = [t.withColumn("part", F.lit(k)) for k, t in enumerate(tables)]
    return reduce(DataFrame.unionByName, whole)


def row_gram(tiles: DataFrame, rows: int = ROWS, cols: int = COLS, distance: bool = False,
             emit: Callable = pair_rows, schema: str = "i long, j long, s double", parts: int = 1,
             sorting: tuple[Callable, Callable, int] | None = None) -> DataFrame:
    """``X X'`` of a stored tile table as long rows ``(i, j, s)`` with ``j <= i``, or with ``distance`` the
    squared distances of rows.

    ``emit(i, j, block)`` turns a block of finished results into rows of ``schema``; another one than
    the default can reduce a block on the spot instead of writing out its pairs. With tiles of ``with_side``
    it also gets the numbers of the rows i and of the rows j. The products of ``parts`` ``stacked`` tables are taken in one
    stream, and a block then holds one matrix for each of them.

    With ``sorting``, a function ``value`` of products, a function ``rows(i, j, values)`` of finished pairs and a number of digits (for one part
    without sides), the rows of two super-blocks come in ``stored_order``, unless their columns are cut into slabs.
    """
    if parts == 1:
        tiles = tiles.withColumn("part", F.lit(0))
    sided = "side" in tiles.columns
    side = ["side"] if sided else []
    spark = tiles.sparkSession
    n_rb, n_cb = block_counts(tiles)
    if n_rb == 0:
        return spark.createDataFrame([], schema)
    span = max(1, min(int(SUPER / parts**0.5), n_rb // 16))
    n_sb = -(-n_rb // span)
    n_pairs = n_sb * (n_sb + 1) // 2
    n_slabs = max(1, min(n_cb, -(-4 * spark.sparkContext.defaultParallelism // n_pairs)))
    slab = -(-n_cb // n_slabs)
    n_slabs = -(-n_cb // slab)
    sb = F.floor(F.col("rb") / span).cast("int")
    keys = ["hi", "lo", "slab"]
    paired = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_sb - 1)))).select(
        F.greatest(sb, "other").alias("hi"), F.least(sb, "other").alias("lo"),
        F.floor(F.col("cb") / slab).cast("int").alias("slab"), "part", "cb", "rb", "x", "mu", "inv", *side)
    ordered = paired.repartition(min(n_pairs * n_slabs, MAX_TASKS), *keys).sortWithinPartitions(*keys, "part", "cb", "rb")

    def finish(hi, lo, first, block, seen_hi, seen_lo, side_hi, side_lo):
        at_i, at_j = np.flatnonzero(seen_hi), np.flatnonzero(seen_lo)
        i, j = hi * span * rows + first + at_i, lo * span * rows + at_j
        if len(at_i) < len(seen_hi) or len(at_j) < len(seen_lo):
            block = block[np.ix_(range(parts), at_i, at_j)]
        block = block[0] if parts == 1 else block
        if distance:
            block = np.where(i[:, None] == j[None], 0.0, np.maximum(block, 0.0))
        return emit(i, j, block, side_hi[at_i], side_lo[at_j]) if sided else emit(i, j, block)

    def pairs_of(state):
        value, rows_of, digits = sorting
        side = state.acc.shape[1]
        bits = (side * side - 1).bit_length()
        values, key, found = state.acc[0], np.empty(side * side, np.int64), 0
        top, left = state.hi * span * rows, state.lo * span * rows
        j = left + np.arange(side)
        for first, block, seen_hi, seen_lo, *_ in state.stripes(distance):
            i = top + first + np.arange(len(seen_hi))
            block = block[0]
            if distance:
                block = np.where(i[:, None] == j[None], 0.0, np.maximum(block, 0.0))
            values[first:first + len(i)] = value(block)
            at_i, at_j = np.nonzero(seen_hi[:, None] & seen_lo[None] & (j[None] <= i[:, None]))
            key[found:found + len(at_i)] = value_keys(values[first + at_i, at_j], (first + at_i) * side + at_j, bits)
            found += len(at_i)
        values = values.ravel()
        for places in stored_order(values, key[:found], bits, digits):
            at_i, at_j = np.divmod(places, side)
            yield rows_of(top + at_i, left + at_j, values[places])

    def product_of(batches):
        state, key = None, None
        for batch in batches:
            columns = (batch.column(n).to_pylist() for n in (*keys, "part", "cb", "rb", "x", "mu", "inv", *side))
            for hi, lo, s, part, cb, rb, *tile in zip(*columns):
                if (hi, lo, s) != key:
                    if state is not None:
                        yield state
                    state, key = _PairProduct(hi, lo, span, rows, cols, parts), (hi, lo, s)
                state.take(part, cb, rb, *tile)
        if state is not None:
            yield state

    if n_slabs == 1:
        def whole(batches):
            for state in product_of(batches):
                if sorting is not None:
                    yield from pairs_of(state)
                    continue
                for first, block, *along in state.stripes(distance):
                    yield finish(state.hi, state.lo, first, block, *along)

        return ordered.mapInArrow(whole, schema)

    def partial(batches):
        for state in product_of(batches):
            for first, block, seen_hi, seen_lo, side_hi, side_lo in state.stripes(distance):
                yield pa.record_batch({
                    "hi": pa.array([state.hi], pa.int32()), "lo": pa.array([state.lo], pa.int32()),
                    "first": pa.array([first], pa.int32()), "part": pa.array([block.tobytes()], pa.binary()),
                    "seen_hi": pa.array([seen_hi.tobytes()], pa.binary()),
                    "seen_lo": pa.array([seen_lo.tobytes()], pa.binary()),
                    "side_hi": pa.array([side_hi.tobytes() if sided else None], pa.binary()),
                    "side_lo": pa.array([side_lo.tobytes() if sided else None], pa.binary())})

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hi, lo, first = (k.as_py() for k in key)
        total, seen_hi, seen_lo, side_hi, side_lo = 0.0, False, False, 0.0, 0.0
        for batch in batches:
            for part, a, b, u, v in zip(*(batch.column(n).to_pylist() for n in ("part", "seen_hi", "seen_lo", "side_hi", "side_lo"))):
                total = total + np.frombuffer(part).reshape(parts, -1, span * rows)
                a, b = np.frombuffer(a, bool), np.frombuffer(b, bool)
                if sided:  # a slab knows the numbers of the rows that it has seen
                    side_hi, side_lo = np.where(a, np.frombuffer(u), side_hi), np.where(b, np.frombuffer(v), side_lo)
                seen_hi, seen_lo = seen_hi | a, seen_lo | b
        yield finish(hi, lo, first, total, seen_hi, seen_lo, side_hi, side_lo)

    add.__annotations__ = {"key": tuple, "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    slabs = ordered.mapInArrow(
        partial, "hi int, lo int, first int, part binary, seen_hi binary, seen_lo binary, side_hi binary, side_lo binary")
    return slabs.groupBy("hi", "lo", "first").applyInArrow(add, schema)


def gram(cells: DataFrame, row: str, col: str, value: str, stats: DataFrame | None = None,
         rows: int = ROWS, cols: int = COLS, **options) -> DataFrame:
    """Sum of products of every two rows over the columns, lower triangle ``(i, j, s)``; columns are
    standardised by ``stats`` where given."""
    tiles = materialise(tile_table(cells, row, col, value, rows, cols, stats))
    return row_gram(tiles, rows, cols, **options)
