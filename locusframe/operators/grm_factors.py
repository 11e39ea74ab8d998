"""Relationship matrices in factors: ``K = F F'`` with a row of ``F`` per individual and a column per marker.

A matrix over n individuals has n x n values, its factor n x p. Where markers are few (``MAX_DRIVER_SIDE`` at most) a table of tiles ``(rb, x, mu, inv)``, each
``ROWS`` individuals by all markers, stands for the matrix, and what is asked of it follows exactly from products of the columns of ``F``:
sums over pairs are sums of squares of such products, the k-th power of every value is the product of rows of monomials of degree k, and the
eigenvalues other than 0 are those of ``F'F``. A task adds up the products of its individuals; time and traffic grow with n.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations_with_replacement
from math import comb, factorial, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.functions.ranking import index_by_integer
from locusframe.operators import grm_tiles
from locusframe.operators.tiles import ABSENT, ROWS, STRIPE, decode, row_gram, tile_table
from locusframe.session import MAX_DRIVER_SIDE, materialise


@dataclass(frozen=True)
class Factors:
    """``K = Z Z' / p``: stored tiles of ``Z``, and the markers ``(idx, name)`` of its columns."""

    tiles: DataFrame
    markers: DataFrame
    p: int

    @property
    def sparkSession(self):  # noqa: N802 (as a DataFrame has it)
        return self.tiles.sparkSession


def factored(cells: DataFrame, col: str, value: str, stats: DataFrame) -> Factors | None:
    """The factor of cells ``(iid, col, value)`` standardised by ``stats(col, mean, sd)``; None where it has too many columns."""
    p = stats.count()
    if p > MAX_DRIVER_SIDE:
        return None
    named = materialise(index_by_integer(stats.select(col, "mean", "sd"), col))
    numbered = cells.join(F.broadcast(named.select(col, "idx")), col).select("iid", "idx", value)  # a row per marker, few by the test above
    tiles = tile_table(numbered, "iid", "idx", value, ROWS, max(p, 1), stats=named.select("idx", "mean", "sd"))
    return Factors(materialise(tiles.select("rb", "x", "mu", "inv")), named.select("idx", F.col(col).alias("name")), p)


def as_tiles(grm: Factors) -> DataFrame:
    """The matrix itself, as the tile table of its n x n values."""
    p = grm.p
    return row_gram(grm.tiles.withColumn("cb", F.lit(0)), ROWS, p, emit=grm_tiles.tile_writer(lambda s: s / p, float(p)), schema=grm_tiles.SCHEMA)


def _side_by_side(grms: list[Factors]) -> DataFrame:
    """Tiles of the same individuals in one row, ``x0, mu0, inv0, x1 ..``; blocks that a matrix lacks are left out."""
    return reduce(lambda a, b: a.join(b, "rb"), (
        g.tiles.select("rb", *(F.col(c).alias(f"{c}{k}") for c in ("x", "mu", "inv"))) for k, g in enumerate(grms)))


def merged(grms: list[Factors]) -> Factors | None:
    """The average weighted by marker counts over the people in all matrices: their markers side by side. None where these are too many."""
    p, sizes = sum(g.p for g in grms), [g.p for g in grms]
    if p > MAX_DRIVER_SIDE:
        return None
    joined = _side_by_side(grms)

    def append(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                kinds = [np.int8 if len(row[f"x{k}"]) == ROWS * c else np.float64 for k, c in enumerate(sizes)]
                parts = [np.frombuffer(row[f"x{k}"], kind).reshape(ROWS, c) for k, (kind, c) in enumerate(zip(kinds, sizes))]
                gone = [x == ABSENT if x.dtype == np.int8 else np.isnan(x) for x in parts]
                if len(set(kinds)) > 1:  # genotypes beside other numbers: a missing call counts as 0 copies, as in ``decode``
                    parts = [np.where(g, np.nan, np.maximum(x, 0)) if x.dtype == np.int8 else x for x, g in zip(parts, gone)]
                missing = np.any([g.all(axis=1) for g in gone], axis=0)
                if not missing.all():
                    x = np.hstack(parts)
                    x[missing] = ABSENT if x.dtype == np.int8 else np.nan
                    mu, inv = (b"".join(row[f"{n}{k}"] for k in range(len(sizes))) for n in ("mu", "inv"))
                    yield pa.record_batch({"rb": pa.array([row["rb"]], pa.int32()), **{n: pa.array([v], pa.binary()) for n, v in (("x", x.tobytes()), ("mu", mu), ("inv", inv))}})

    tiles = materialise(joined.mapInArrow(append, "rb int, x binary, mu binary, inv binary"))
    starts = np.cumsum([0, *sizes[:-1]]).tolist()
    markers = reduce(DataFrame.unionByName, [g.markers.select((F.col("idx") + at).alias("idx"), "name") for g, at in zip(grms, starts)])
    return Factors(tiles, markers, p)


def individuals(grm: Factors) -> DataFrame:
    p = grm.p

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rb, *tile in zip(*(c.to_pylist() for c in batch.columns)):
                yield pa.record_batch({"iid": (rb * ROWS + np.flatnonzero(decode(*tile, ROWS, p)[1])).astype(np.int64)})

    return grm.tiles.select("rb", "x", "mu", "inv").mapInArrow(unpack, "iid long")


def monomials(p: int, power: int) -> tuple[np.ndarray, np.ndarray]:
    """The monomials of degree ``power`` of p columns, and the roots of how often each occurs in the power of a product of rows."""
    picks = np.array(list(combinations_with_replacement(range(p), power)), np.int64).reshape(-1, power)
    times = [factorial(power) / prod(factorial(c) for c in np.unique(pick, return_counts=True)[1].tolist()) for pick in picks]
    return picks, np.sqrt(np.array(times))


def too_many(grms: list[Factors], epi: int, terms: int = 3) -> bool:
    """Whether the products of all columns of a model, powers of the first matrix up to ``epi``, are more than one task may hold."""
    return terms + sum(comb(grms[0].p + k - 1, k) for k in range(1, epi + 1)) + sum(g.p for g in grms[1:]) > MAX_DRIVER_SIDE


def number_rows(numbers: DataFrame, terms: int) -> DataFrame:
    """Numbers ``(iid, term, v)`` of individuals in stored blocks ``(rb, side)``, absent ones 0; term 0 is 1 for those who take part."""
    keyed = numbers.select(F.expr(f"iid div {ROWS}").cast("int").alias("rb"), F.pmod("iid", F.lit(ROWS)).cast("int").alias("at"), "term", F.col("v").cast("double").alias("v"))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        side = np.zeros((ROWS, terms))
        side[table.column("at").to_numpy(), table.column("term").to_numpy()] = table.column("v").to_numpy()
        return pa.table({"rb": pa.array([key[0].as_py()], pa.int32()), "side": pa.array([side.tobytes()], pa.binary())})

    pack.__annotations__ = {"key": tuple, "table": pa.Table, "return": pa.Table}
    return materialise(keyed.groupBy("rb").applyInArrow(pack, "rb int, side binary"))


def column_products(grms: list[Factors], side: DataFrame, terms: int, epi: int = 1, squares: bool = False) -> tuple[np.ndarray, np.ndarray, list[slice]]:
    """``A'A`` of the columns (numbers of ``side``, squares of the second of them where asked, the components' columns), and ``D'D`` of the components' diagonals with a one ahead.

    The components are the first matrix, its powers 2..epi and the others; the slices say which columns are theirs. The people are those of
    ``side`` who are in all matrices.
    """
    sizes = [g.p for g in grms]
    powers = [monomials(sizes[0], k) for k in range(2, epi + 1)]
    widths = [sizes[0], *(len(m[0]) for m in powers), *sizes[1:]]
    first = terms + squares
    ends = np.cumsum([first, *widths])
    total, count = int(ends[-1]), len(widths) + 1
    joined = _side_by_side(grms).join(side, "rb")
    spark = joined.sparkSession
    spread = joined.repartition(2 * spark.sparkContext.defaultParallelism, "rb")

    def columns(row: dict) -> tuple[np.ndarray, np.ndarray]:
        numbers = np.frombuffer(row["side"]).reshape(ROWS, terms)
        known, parts = numbers[:, 0] == 1.0, []
        for k, p in enumerate(sizes):
            values, present, _ = decode(row[f"x{k}"], row[f"mu{k}"], row[f"inv{k}"], ROWS, p)
            known = known & present
            parts.append(values / np.sqrt(p))
        numbers, parts = numbers[known], [v[known] for v in parts]
        higher = []
        for picks, weight in powers:
            out = parts[0][:, picks[:, 0]] * weight
            for c in range(1, picks.shape[1]):
                out *= parts[0][:, picks[:, c]]
            higher.append(out)
        every = [parts[0], *higher, *parts[1:]]
        diagonals = np.stack([np.ones(len(numbers)), *(np.einsum("ij,ij->i", v, v) for v in every)], 1)
        return np.hstack([numbers, *([numbers[:, 1:2] ** 2] if squares else []), *every]), diagonals

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, small = None, np.zeros((count, count))
        for batch in batches:
            for row in batch.to_pylist():
                a, d = columns(row)
                whole = a.T @ a if whole is None else whole + a.T @ a
                small += d.T @ d
        if whole is not None:
            for at in range(0, total, STRIPE):
                yield pa.record_batch({"at": pa.array([at], pa.int32()), "s": pa.array([np.ascontiguousarray(whole[at : at + STRIPE]).tobytes()], pa.binary())})
            yield pa.record_batch({"at": pa.array([-1], pa.int32()), "s": pa.array([small.tobytes()], pa.binary())})

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = 0.0
        for batch in batches:
            for s in batch.column("s"):
                out = out + np.frombuffer(s.as_buffer())
        yield pa.record_batch({"at": pa.array([key[0].as_py()], pa.int32()), "s": pa.array([out.tobytes()], pa.binary())})

    add.__annotations__ = {"key": tuple, "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    whole, small = np.zeros((total, total)), np.zeros((count, count))
    for at, s in spread.mapInArrow(run, "at int, s binary").groupBy("at").applyInArrow(add, "at int, s binary").collect():
        if at < 0:
            small = np.frombuffer(s).reshape(count, count)
        else:
            whole[at : at + STRIPE] = np.frombuffer(s).reshape(-1, total)
    return whole, small, [slice(a, b) for a, b in zip(ends[:-1], ends[1:])]


def trace_stats(grm: Factors) -> DataFrame:
    """``n``, ``trace`` and ``sum_sq`` of the full symmetric matrix."""
    everyone = number_rows(individuals(grm).select("iid", F.lit(0).alias("term"), F.lit(1.0).alias("v")), 1)
    whole, small, (own,) = column_products([grm], everyone, 1)
    return grm.sparkSession.createDataFrame([(int(small[0, 0]), float(small[0, 1]), float((whole[own, own] ** 2).sum()))],
                                            "n long, trace double, sum_sq double")


def pair_sums(grms: list[Factors], pheno: DataFrame, epi: int) -> np.ndarray:
    """Products of (1, components.., z) summed over all pairs j < i, ``z = (y_i - y_j)^2``, as a matrix."""
    known = pheno.where("y is not null").select("iid", F.col("y").cast("double").alias("y"))
    numbers = known.select("iid", F.lit(0).alias("term"), F.lit(1.0).alias("v")).unionByName(known.select("iid", F.lit(1).alias("term"), F.col("y").alias("v")))
    whole, small, slices = column_products(grms, number_rows(numbers, 2), 2, epi, squares=True)
    slices = [slice(0, 1), *slices]  # the ones of the intercept are a component of one column
    k = len(slices)
    out = np.zeros((k + 1, k + 1))
    for a, left in enumerate(slices):
        for b, right in enumerate(slices):
            out[a, b] = ((whole[left, right] ** 2).sum() - small[a, b]) / 2
        out[a, k] = out[k, a] = whole[left, 0] @ whole[left, 2] - whole[left, 1] @ whole[left, 1]
    n, y1, y2, y3, y4 = whole[0, 0], whole[0, 1], whole[0, 2], whole[1, 2], whole[2, 2]
    out[k, k] = n * y4 - 4 * y1 * y3 + 3 * y2 * y2
    return out
