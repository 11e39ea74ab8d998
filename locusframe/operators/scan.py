"""Regional heritability scan over sliding blocks of kept markers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.functions.ranking import index_by_integer
from locusframe.functions.scalar import MAX_DELTA
from locusframe.operators.qc import judge, kept_markers, marker_sums_from_tiles, qc_report, stats_from_sums
from locusframe.operators.regression import TASK_BYTES
from locusframe.operators.reml import fit_people, fixed_effects, maximise, project_out, spectrum_from_products, summed_blocks
from locusframe.operators.tiles import ABSENT, COLS, ROWS, tile_table
from locusframe.session import MAX_DRIVER_SIDE, materialise

SCAN_ROWS = 4096
GROUP_MARKERS = 512
FAN_IN = 256
RETRY_MAF = 0.03

SCHEMA = ("block int, start_idx int, end_idx int, n_markers int, delta double, h2 double, vg double, ve double,"
          " reml_ll double, n double, y_ss double, n_fixed double, status string")


def window_count(p: int, block: int, stride: int) -> int:
    """Blocks start every ``stride`` markers and stop with the first that reaches the end."""
    if p <= 0:
        return 0
    return 1 if p <= block else 1 + -(-(p - block) // stride)


def region_windows(markers: DataFrame, block: int, stride: int) -> DataFrame:
    """Members of each block: ``(block, start_idx, end_idx, idx, marker)`` over densely re-indexed markers."""
    p = markers.count()
    last = window_count(p, block, stride) - 1
    idx = F.col("idx")
    first = F.greatest(F.lit(0), F.ceil((idx - (block - 1)) / F.lit(float(stride)))).cast("int")
    final = F.least(F.lit(last), F.floor(idx / F.lit(float(stride)))).cast("int")
    member = index_by_integer(markers, "marker").withColumn("_f", first).withColumn("_l", final)
    member = member.filter("_l >= _f").withColumn("block", F.explode(F.sequence("_f", "_l")))
    start = F.col("block") * stride
    return member.select("block", start.cast("int").alias("start_idx"),
                         F.least(start + block, F.lit(p)).cast("int").alias("end_idx"),
                         F.col("idx").cast("int").alias("idx"), "marker")


def scan_regions(geno: DataFrame, pheno: DataFrame, block: int = 50, stride: int = 25,
                 covariates: DataFrame | None = None, report: DataFrame | None = None) -> DataFrame:
    """REML delta of every block, from genotype rows: they are packed into tiles once, see ``scan_tiles``."""
    cells = geno.select("iid", "marker", F.col("dosage").cast("int").alias("dosage"))
    rows = min(ROWS, SCAN_ROWS)
    return scan_tiles(materialise(tile_table(cells, "iid", "marker", "dosage", rows)), pheno, block, stride, covariates,
                      report if report is not None else qc_report(geno), rows)


def _people_of(tiles: DataFrame, rows: int, cols: int) -> DataFrame:
    """``iid`` of those with any cell in a tile table; a task merges what it sees of a row block."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for rb, x in zip(batch.column("rb").to_pylist(), batch.column("x").to_pylist()):
                have = (np.frombuffer(x, np.int8).reshape(rows, cols) != ABSENT).any(axis=1)
                found[rb] = found[rb] | have if rb in found else have
        for rb, have in found.items():
            yield pa.record_batch({"iid": rb * rows + np.flatnonzero(have)})

    return tiles.select("rb", "x").mapInArrow(seen, "iid long").distinct()


def _design_blocks(design: DataFrame, terms: int, rows: int) -> DataFrame:
    """The long design ``(iid, term, v)`` as stored blocks ``(rb, d)`` of ``rows`` by ``terms`` values; rows of zeros take no part."""
    keyed = design.select(F.expr(f"iid div {rows}").cast("int").alias("rb"), F.pmod("iid", F.lit(rows)).cast("int").alias("at"), "term", "v")

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        d = np.zeros((rows, terms))
        d[table.column("at").to_numpy(), table.column("term").to_numpy()] = table.column("v").to_numpy()
        return pa.table({"rb": pa.array([key[0].as_py()], pa.int32()), "d": pa.array([d.tobytes()], pa.binary())})

    pack.__annotations__ = {"key": tuple, "table": pa.Table, "return": pa.Table}
    return materialise(keyed.groupBy("rb").applyInArrow(pack, "rb int, d binary"))


def _with_design(tiles: DataFrame, blocks: DataFrame, terms: int, rows: int, cols: int) -> DataFrame:
    """``marker, g``: sums of dosage with every term of the design, one pass over the tiles."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}

        def sent() -> pa.RecordBatch:
            return pa.record_batch({"cb": pa.array(list(sums), pa.int32()), "s": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

        for batch in batches:
            for cb, x, d in zip(*(batch.column(c).to_pylist() for c in ("cb", "x", "d"))):
                out = np.maximum(np.frombuffer(x, np.int8).reshape(rows, cols), 0).T.astype(float) @ np.frombuffer(d).reshape(rows, terms)
                sums[cb] = sums[cb] + out if cb in sums else out
                if len(sums) * out.nbytes > TASK_BYTES:
                    yield sent()
                    sums = {}
        yield sent()

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((cols, terms))
        for batch in batches:
            for s in batch.column("s"):
                total += np.frombuffer(s.as_buffer()).reshape(cols, terms)
        yield pa.record_batch({"marker": pa.array((key[0].as_py() * cols + np.arange(cols)).astype(np.int32)),
                               "g": pa.array(list(total), pa.list_(pa.float64()))})

    add.__annotations__ = {"key": tuple, "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return tiles.select("rb", "cb", "x").join(blocks, "rb").select("cb", "x", "d").mapInArrow(
        products, "cb int, s binary").groupBy("cb").applyInArrow(add, "marker int, g array<double>")


def _kept_columns(info: DataFrame, cols: int) -> DataFrame:
    """Per block of columns the places of its kept markers and the position ``first`` of the first among all kept: ``(cb, first, at)``."""
    return materialise(info.groupBy(F.floor(F.col("marker") / cols).cast("int").alias("cb")).agg(
        F.min("idx").alias("first"), F.sort_array(F.collect_list(F.pmod("marker", F.lit(cols)))).alias("at")))  # at most ``cols`` places


def scan_tiles(tiles: DataFrame, pheno: DataFrame, block: int = 50, stride: int = 25, covariates: DataFrame | None = None,
               report: DataFrame | None = None, rows: int = ROWS, cols: int = COLS) -> DataFrame:
    """REML delta of every block of kept markers, from a stored table of packed genotypes.

    A tile sends its kept columns to the runs of neighbouring blocks that they lie in, packed. Marker products are taken per (run, slice of individuals),
    so a task sees a bounded rectangle of genotypes and emits one small matrix per block; sums over slices have a
    bounded fan-in. So each tile meets only the neighbours within a run, and runs overlap by ``block - stride`` markers, which is all
    that is sent twice. The eigenproblem of a block has the size of the block. No genotype is a row.

    Covariates ``(iid, cov, value)`` are fixed effects; with the intercept at most ``MAX_DRIVER_SIDE - 1`` terms, whose products every block needs.
    Whoever lacks a phenotype, genotypes or one of the covariates takes no part; of rows that repeat an individual's covariate the smallest value counts.
    """
    spark = tiles.sparkSession
    if report is None:
        report = judge(stats_from_sums(marker_sums_from_tiles(tiles, rows, cols)))
    info = materialise(index_by_integer(kept_markers(materialise(report)).select("marker", "maf"), "marker"))
    p = info.count()
    n_windows = window_count(p, block, stride)
    if n_windows == 0:
        return spark.createDataFrame([], SCHEMA)
    per_run = max(1, (GROUP_MARKERS - block) // stride + 1)
    width = (per_run - 1) * stride + block

    # everyone with a phenotype, genotypes and all covariates takes part in every sum
    people = fit_people(_people_of(tiles, rows, cols), pheno, covariates)
    design, n_fixed = fixed_effects(people, covariates)
    if n_fixed >= MAX_DRIVER_SIDE:
        raise ValueError(f"{n_fixed} fixed effects exceed the bound of {MAX_DRIVER_SIDE - 1}")
    terms = n_fixed + 1
    design = design.unionByName(people.select("iid", F.lit(n_fixed).alias("term"), F.col("y").alias("v")))
    blocks = _design_blocks(design, terms, rows)
    known = summed_blocks(blocks.select("d"), lambda d: (m := d.reshape(rows, terms)).T @ m, terms * terms).reshape(terms, terms)
    side = materialise(info.join(_with_design(tiles, blocks, terms, rows, cols), "marker"))

    def to_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The kept columns of each tile, cut to the runs of blocks that they lie in; people of no fit are zero."""
        for batch in batches:
            out: list[tuple] = []
            for rb, x, d, first, at in zip(*(batch.column(c).to_pylist() for c in ("rb", "x", "d", "first", "at"))):
                have = np.frombuffer(d).reshape(rows, terms)[:, :1] != 0
                part = np.where(have, np.maximum(np.frombuffer(x, np.int8).reshape(rows, cols)[:, at], 0), 0).astype(np.int8)
                low = max(0, -(-(first - width + 1) // (per_run * stride)))
                high = min((n_windows - 1) // per_run, (first + len(at) - 1) // (per_run * stride))
                for run in range(low, high + 1):
                    start = run * per_run * stride
                    a, b = max(start, first), min(start + width, first + len(at))
                    if a < b:
                        out.append((rb * rows // SCAN_ROWS, run, rb * rows % SCAN_ROWS, a - start, b - a, part[:, a - first : b - first].tobytes()))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], ["part", "run", "row", "col", "wide", "x"])

    def products(key, table):
        part, run = key[0].as_py(), key[1].as_py()
        x = np.zeros((SCAN_ROWS, width), np.float32)
        for row, col, wide, data in zip(*(table.column(c).to_pylist() for c in ("row", "col", "wide", "x"))):
            x[row:row + rows, col:col + wide] = np.frombuffer(data, np.int8).reshape(rows, wide)
        numbers, mats = [], []
        for w in range(per_run):
            if run * per_run + w < n_windows:
                part_x = x[:, w * stride:w * stride + block]
                numbers.append(run * per_run + w)
                # Sums of products of 0, 1, 2 over a slice stay below 2^24, so single precision is exact.
                mats.append((part_x.T @ part_x).astype(np.float64).tobytes())
        return pa.table({"block": pa.array(numbers, pa.int32()), "slice": pa.array([part] * len(numbers), pa.int64()), "m": pa.array(mats, pa.binary())})

    def add(key, table):
        total = np.zeros(block * block)
        for m in table.column("m"):
            total += np.frombuffer(m.as_buffer())
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()),
                         "slice": pa.array([key[1].as_py()], pa.int64()), "m": pa.array([total.tobytes()], pa.binary())})

    if SCAN_ROWS % rows:
        raise ValueError(f"tiles of {rows} rows don't fill a slice of {SCAN_ROWS}")
    sent = tiles.select("rb", "cb", "x").join(blocks, "rb").join(_kept_columns(info, cols), "cb").select("rb", "x", "d", "first", "at").mapInArrow(
        to_runs, "part long, run int, row int, col int, wide int, x binary")
    mats = materialise(sent.groupBy("part", "run").applyInArrow(products, "block int, slice long, m binary"))
    slices = (mats.agg(F.max("slice")).first()[0] or 0) + 1
    while slices > FAN_IN:
        mats = mats.withColumn("slice", F.floor(F.col("slice") / FAN_IN)).groupBy("block", "slice").applyInArrow(
            add, "block int, slice long, m binary")
        slices = -(-slices // FAN_IN)

    members = region_windows(info.select("marker"), block, stride).join(side.drop("idx"), "marker")
    n_obs = known[0, 0]

    def fit(key, parts, rows):
        total = np.zeros(block * block)
        for m in parts.column("m"):
            total += np.frombuffer(m.as_buffer())
        rows = rows.sort_by("idx")
        m = rows.num_rows
        dosage = total.reshape(block, block)[:m, :m]
        with_design = rows.column("g").combine_chunks().flatten().to_numpy().astype(float).reshape(m, -1)
        maf = rows.column("maf").to_numpy()
        start = rows.column("start_idx")[0].as_py()
        out = _fit_block(dosage, with_design, known, n_obs, n_fixed, maf)
        return pa.table({name: [value] for name, value in {
            "block": key[0].as_py(), "start_idx": start, "end_idx": start + m, "n_markers": m, **out}.items()},
            schema=pa.schema([("block", pa.int32()), ("start_idx", pa.int32()), ("end_idx", pa.int32()),
                              ("n_markers", pa.int32()), *((c, pa.float64()) for c in
                                                            ("delta", "h2", "vg", "ve", "reml_ll", "n", "y_ss", "n_fixed")),
                              ("status", pa.string())]))

    return mats.groupBy("block").cogroup(members.groupBy("block")).applyInArrow(fit, SCHEMA)


def _fit_block(dosage, with_design, known, n, n_fixed, maf):
    """REML of one block; on failure once more without rare markers, then the largest delta."""
    mean = with_design[:, 0] / n
    sd = np.sqrt(np.maximum(np.diag(dosage) / n - mean * mean, 0.0))
    sd = np.where(sd == 0, 1.0, sd)
    # squares of y around the fixed effects
    y_ss = float(project_out(known, n_fixed)[-1, -1])
    common = {"n": n, "y_ss": y_ss, "n_fixed": float(n_fixed)}
    for tried, keep in (("converged", np.ones(len(maf), bool)), ("rare markers dropped", maf >= RETRY_MAF)):
        try:
            m, s = int(keep.sum()), sd[keep]
            if m == 0:
                break
            size = len(known)
            full = np.zeros((size + m, size + m))
            full[:size, :size] = known
            full[size:, :size] = (with_design[keep] - np.outer(mean[keep], known[0])) / s[:, None]
            full[:size, size:] = full[size:, :size].T
            full[size:, size:] = (dosage[np.ix_(keep, keep)] - n * np.outer(mean[keep], mean[keep])) / np.outer(s, s)
            order = [*range(n_fixed), *range(size, size + m), size - 1]
            left = project_out(full[np.ix_(order, order)], n_fixed)
            spec = spectrum_from_products(left[:-1, :-1], left[:-1, -1], left[-1, -1], n, n_fixed)
            best = maximise(spec)
            status = best["status"] if tried == "converged" else tried
            return {k: best[k] for k in ("delta", "h2", "vg", "ve", "reml_ll")} | common | {"status": status}
        except (np.linalg.LinAlgError, ValueError):
            continue
    return {"delta": MAX_DELTA, "h2": 1.0 / (1.0 + MAX_DELTA), "vg": math.nan, "ve": math.nan, "reml_ll": math.nan,
            **common, "status": "default"}
