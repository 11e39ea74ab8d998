"""PLINK binary genotypes as a Spark data source, with its marker and sample tables.

``spark.read.format("plink_bed")`` splits a SNP-major file by byte ranges: a partition is a run of
markers (or a slice of individuals of one marker, where a single marker is large), read with one
seek. Filters on ``marker`` prune partitions before anything is read. The writer range-partitions
by file position, so every task writes one contiguous, byte-aligned run.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition,
    LessThan, LessThanOrEqual, WriterCommitMessage,
)

from locusframe.functions.ranking import SPAN, with_row_index
from locusframe.operators.tiles import ABSENT, COLS, ROWS
from locusframe.session import materialise, qualified

# Fixed values of the file format: header bytes, and the dosage of each 2-bit code 0, 1, 2, 3.
BED_HEADER = bytes([108, 27, 1])
DOSAGE_OF_CODE = np.array([2, -1, 1, 0], np.int8)
CODE_OF_DOSAGE = np.array([3, 2, 0, 1], np.uint8)  # indexed by dosage 0, 1, 2, -1

GENO_SCHEMA = "iid long, marker int, dosage int"
READ_CELLS = 1 << 22
BATCH_CELLS = 1 << 18
TILE_BYTES = 32 << 20


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and plain path of a local path or URI (hdfs://, s3://, ..)."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


@dataclass
class MarkerRun(InputPartition):
    path: str
    base: int
    first: int
    last: int
    from_byte: int
    to_byte: int


class BedReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.n = int(options["samples"])
        self.low, self.high, self.wanted = 0, None, None

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) == ("marker",):
                if isinstance(f, EqualTo):
                    self.wanted = {f.value} if self.wanted is None else self.wanted & {f.value}
                    continue
                if isinstance(f, In):
                    self.wanted = set(f.value) if self.wanted is None else self.wanted & set(f.value)
                    continue
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                    continue
                if isinstance(f, (LessThan, LessThanOrEqual)):
                    top = f.value - isinstance(f, LessThan)
                    self.high = top if self.high is None else min(self.high, top)
                    continue
            yield f

    def partitions(self):
        stride = -(-self.n // 4)
        runs = []
        for path, base, count in bed_files(self.path, stride):
            lo, hi = max(self.low, base), base + count - 1
            hi = hi if self.high is None else min(hi, self.high)
            if self.wanted is not None:
                for m in sorted(w for w in self.wanted if lo <= w <= hi):
                    runs.extend(self._cut(path, base, m, m, stride))
                continue
            if lo <= hi:
                step = max(1, READ_CELLS // (4 * stride))
                for m in range(lo, hi + 1, step):
                    runs.extend(self._cut(path, base, m, min(m + step - 1, hi), stride))
        return runs or [MarkerRun(self.path, 0, 0, -1, 0, 0)]

    @staticmethod
    def _cut(path, base, first, last, stride):
        if first < last or stride * 4 <= READ_CELLS:
            return [MarkerRun(path, base, first, last, 0, stride)]
        step = READ_CELLS // 4
        return [MarkerRun(path, base, first, last, b, min(b + step, stride)) for b in range(0, stride, step)]

    def read(self, run):
        if run.first > run.last:
            return
        stride = -(-self.n // 4)
        fs, path = open_fs(run.path)
        width, first = run.to_byte - run.from_byte, run.from_byte * 4
        samples = np.arange(first, min(first + 4 * width, self.n), dtype=np.int64)
        # Whole runs of markers per batch; slices of one marker come alone.
        step = max(1, BATCH_CELLS // len(samples)) if width == stride else 1
        with fs.open_input_file(path) as f:
            for marker in range(run.first, run.last + 1, step):
                count = min(step, run.last + 1 - marker)
                size = width if step == 1 else stride * count
                raw = f.read_at(size, 3 + stride * (marker - run.base) + run.from_byte)
                if len(raw) != size:
                    raise ValueError(f"corrupt genotype file {run.path}: marker {marker} is incomplete")
                codes = np.frombuffer(raw, np.uint8).reshape(count, width)
                pairs = np.stack([(codes >> s) & 3 for s in (0, 2, 4, 6)], axis=2).reshape(count, -1)
                dosage = DOSAGE_OF_CODE[pairs[:, :len(samples)]].astype(np.int32)
                yield pa.record_batch({
                    "iid": pa.array(np.tile(samples, count)),
                    "marker": pa.array(np.repeat(np.arange(marker, marker + count, dtype=np.int32), len(samples))),
                    "dosage": pa.array(dosage.ravel())})


@dataclass
class TileRun(InputPartition):
    path: str
    base: int
    block: int
    first: int
    last: int
    from_byte: int
    to_byte: int


class BedTileReader(DataSourceReader):
    """Tiles straight from the packed file: a partition is a block of markers and a range of individuals,
    one contiguous read per marker. Genotypes never become rows."""

    def __init__(self, options):
        self.path, self.n = options["path"], int(options["samples"])
        self.rows, self.cols = int(options.get("rows", ROWS)), int(options.get("cols", COLS))

    def partitions(self):
        stride = -(-self.n // 4)
        step = max(TILE_BYTES // self.cols // (self.rows // 4), 1) * (self.rows // 4)
        runs = []
        for path, base, count in bed_files(self.path, stride):
            first = base
            while first < base + count:
                block = first // self.cols
                last = min((block + 1) * self.cols, base + count) - 1
                runs.extend(TileRun(path, base, block, first, last, b, min(b + step, stride)) for b in range(0, stride, step))
                first = last + 1
        return runs

    def read(self, run):
        fs, path = open_fs(run.path)
        stride, width, per = -(-self.n // 4), run.to_byte - run.from_byte, self.rows // 4
        with fs.open_input_file(path) as f:
            packed = [f.read_at(width, 3 + stride * (m - run.base) + run.from_byte) for m in range(run.first, run.last + 1)]
        if any(len(p) != width for p in packed):
            raise ValueError(f"corrupt genotype file {run.path}")
        codes = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, width)
        for at in range(0, width, per):
            part = codes[:, at:at + per]
            dosage = DOSAGE_OF_CODE[np.stack([(part >> s) & 3 for s in (0, 2, 4, 6)], axis=2).reshape(len(part), -1)]
            start = (run.from_byte + at) * 4
            dosage = dosage[:, :max(0, min(self.n - start, self.rows))]
            tile = np.full((self.rows, self.cols), ABSENT, np.int8)
            to = run.first - run.block * self.cols
            tile[:dosage.shape[1], to:to + len(part)] = dosage.T
            yield pa.record_batch({
                "rb": pa.array([start // self.rows], pa.int32()), "cb": pa.array([run.block], pa.int32()),
                "x": pa.array([tile.tobytes()], pa.binary())})


class PlinkTiles(DataSource):
    @classmethod
    def name(cls):
        return "plink_tiles"

    def schema(self):
        return "rb int, cb int, x binary"

    def reader(self, schema):
        return BedTileReader(self.options)


def read_bed_tiles(spark: SparkSession, path: str, n_samples: int, rows: int = ROWS, cols: int = COLS) -> DataFrame:
    """Raw tiles ``(rb, cb, x)`` of a genotype file. ``rows`` must be a multiple of 4.

    Part files that end inside a block of markers give two tiles of that block, which are merged.
    """
    if rows % 4:
        raise ValueError("rows per tile must be a multiple of 4")
    spark.dataSource.register(PlinkTiles)
    path = qualified(spark, path)
    tiles = (spark.read.format("plink_tiles").option("path", path).option("samples", n_samples)
             .option("rows", rows).option("cols", cols).load())
    stride = -(-n_samples // 4)
    files = bed_files(path, stride)
    split = {base // cols for _, base, _ in files if base % cols}
    if not split:
        return tiles

    def merge(key, table):
        parts = [np.frombuffer(x.as_buffer(), np.int8) for x in table.column("x")]
        return pa.table({"rb": pa.array([key[0].as_py()], pa.int32()), "cb": pa.array([key[1].as_py()], pa.int32()),
                         "x": pa.array([np.maximum.reduce(parts).tobytes()], pa.binary())})

    shared = tiles.filter(F.col("cb").isin(sorted(split)))
    return tiles.filter(~F.col("cb").isin(sorted(split))).unionByName(
        shared.groupBy("rb", "cb").applyInArrow(merge, "rb int, cb int, x binary"))


def bed_files(path: str, stride: int) -> list[tuple[str, int, int]]:
    """Files of a data set as (path, first marker, markers): one .bed file, or a folder of parts
    ``part-<first marker>-<id>.bed`` each with its own header."""
    fs, plain = open_fs(path)
    info = fs.get_file_info(plain)
    if info.type == pafs.FileType.Directory:
        infos = [i for i in fs.get_file_info(pafs.FileSelector(plain)) if i.base_name.endswith(".bed")]
        parts = [(f"{path}/{i.base_name}", int(i.base_name.split("-")[1]), i) for i in infos]
    elif info.type == pafs.FileType.File:
        parts = [(path, 0, info)]
    else:
        raise FileNotFoundError(path)
    out = []
    for name, base, i in sorted(parts, key=lambda t: t[1]):
        with fs.open_input_file(i.path) as f:
            head = f.read_at(3, 0)
        if head[:2] != BED_HEADER[:2]:
            raise ValueError(f"not a valid genotype file: {name}")
        if head != BED_HEADER:
            raise ValueError(f"not in SNP-major order: {name}")
        if (i.size - 3) % stride:
            raise ValueError(f"corrupt genotype file {name}: size does not fit the number of samples")
        out.append((name, base, (i.size - 3) // stride))
    return out


@dataclass
class Written(WriterCommitMessage):
    path: str


class BedWriter(DataSourceArrowWriter):
    """Packs rows sorted by (marker, pos) into 2-bit codes.

    ``layout=parts``: a part file per task, whole markers each. ``layout=single``: every task writes
    its runs at their byte offsets in one file (needs a POSIX file system all executors share).
    """

    def __init__(self, options):
        self.path, self.n = options["path"], int(options["samples"])
        self.single = options.get("layout", "parts") == "single"
        self.token = uuid.uuid4().hex

    def write(self, batches):
        stride = -(-self.n // 4)
        fs, plain = open_fs(self.path)
        out, name, started, left = None, "", None, (np.zeros(0, np.int64), np.zeros(0, np.uint8))
        for batch in batches:
            marker = batch.column("marker").to_numpy().astype(np.int64)
            pos = batch.column("pos").to_numpy().astype(np.int64)
            codes = CODE_OF_DOSAGE[batch.column("dosage").to_numpy()]
            byte = np.concatenate([left[0], marker * stride + pos // 4])
            value = np.concatenate([left[1], codes << (2 * (pos % 4)).astype(np.uint8)])
            if not len(byte):
                continue
            if started is None:
                started = int(byte[0])
                if self.single:
                    out, name = _positioned(plain), plain
                else:
                    name = f"{plain}/part-{started // stride:012d}-{self.token}-{uuid.uuid4().hex}.bed"
                    out = fs.open_output_stream(name)
                    out.write(BED_HEADER)
            done = byte < byte[-1]
            self._flush(out, byte[done], value[done])
            left = (byte[~done], value[~done])
        if started is not None:
            self._flush(out, *left)
            out.close()
        return Written(name)

    def _flush(self, out, byte, value):
        if not len(byte):
            return
        where, at = np.unique(byte, return_index=True)
        packed = np.bitwise_or.reduceat(value, at).astype(np.uint8)
        if not self.single:
            out.write(packed.tobytes())
            return
        for run in np.split(np.arange(len(where)), np.flatnonzero(np.diff(where) != 1) + 1):
            out.seek(3 + int(where[run[0]]))
            out.write(packed[run].tobytes())

    def commit(self, messages):
        """Part files of failed or repeated attempts are not in the messages and leave the folder."""
        if not self.single:
            fs, plain = open_fs(self.path)
            good = {m.path for m in messages if m and m.path}
            for info in fs.get_file_info(pafs.FileSelector(plain)):
                if self.token in info.base_name and info.path not in good:
                    fs.delete_file(info.path)

    def abort(self, messages):
        if not self.single:
            fs, plain = open_fs(self.path)
            for info in fs.get_file_info(pafs.FileSelector(plain)):
                if self.token in info.base_name:
                    fs.delete_file(info.path)


def _positioned(path: str):
    return open(path, "r+b")


class PlinkBed(DataSource):
    @classmethod
    def name(cls):
        return "plink_bed"

    def schema(self):
        return GENO_SCHEMA

    def reader(self, schema):
        return BedReader(self.options)

    def writer(self, schema, overwrite):
        return BedWriter(self.options)


def in_file_order(lines: DataFrame, name: str = "line") -> DataFrame:
    """Number lines by file name, block of the file, and position in the block.

    ``lines`` has ``_file, _start, _m``: the file, the block's start, and an id that grows within a block. Spark packs files into
    tasks by size, so an id alone doesn't follow the order of a folder's parts. Lines are numbered within their file, in
    runs of one block; what is ordered in one task is a row per file.
    """
    inside = with_row_index(lines, ["_m"], F.col("_start"), by=("_file",), name="_row")
    sizes = lines.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    return inside.join(offsets, "_file").withColumn(name, (F.col("_row") + F.col("_offset")).cast("long")).drop("_row", "_offset")


def indexed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file, or of the parts of a folder in the order of their names, with their 0-based number."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_m"))
    return in_file_order(lines.filter(F.trim("value") != "")).select("line", "value")


def _tokens(lines: DataFrame) -> DataFrame:
    return lines.select("line", F.split(F.trim("value"), r"\s+").alias("t"))


def read_bim(spark: SparkSession, prefix: str) -> DataFrame:
    """Marker table in file order."""
    return _tokens(indexed_lines(spark, prefix + ".bim")).select(
        F.col("line").cast("int").alias("marker"), F.col("t")[0].alias("chrom"), F.col("t")[1].alias("rsid"),
        F.col("t")[2].cast("double").alias("cm"), F.col("t")[3].cast("long").alias("pos"),
        F.col("t")[4].alias("a1"), F.col("t")[5].alias("a2"))


def read_fam(spark: SparkSession, prefix: str) -> DataFrame:
    """Sample table in file order; ``iid`` is the position."""
    t = F.col("t")
    return _tokens(indexed_lines(spark, prefix + ".fam")).select(
        F.col("line").alias("iid"), t[0].alias("fid"), t[1].alias("iid_str"), t[2].alias("father"),
        t[3].alias("mother"), t[4].cast("int").alias("gender"), t[5].cast("double").alias("status"))


def read_bed(spark: SparkSession, path: str, n_samples: int) -> DataFrame:
    """Genotype rows of a file or a folder of parts; filters on ``marker`` decide what is read."""
    spark.dataSource.register(PlinkBed)
    path = qualified(spark, path)
    # Off by default, and a reader that takes filters is refused while it is off.
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("plink_bed").option("path", path).option("samples", n_samples).load()


def read_plink(spark: SparkSession, prefix: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Genotypes, markers (duplicate names made unique) and samples of a data set."""
    fam, bim = read_fam(spark, prefix), read_bim(spark, prefix)
    geno = read_bed(spark, prefix + ".bed", fam.count())
    return geno, rename_duplicates(bim), fam


def rename_duplicates(markers: DataFrame) -> DataFrame:
    """Every occurrence of a repeated rsid becomes ``rsid:dupN``, N counting in file order.

    A name can fill much of a file (unnamed markers share one), so occurrences are counted per
    bucket of positions and not in one window per name.
    """
    counted = with_row_index(markers, ["marker"], F.floor(F.col("marker") / SPAN), by=("rsid",), name="_nth")
    totals = markers.groupBy("rsid").agg(F.count(F.lit(1)).alias("_total"))
    name = F.when(F.col("_total") > 1, F.concat("rsid", F.lit(":dup"), (F.col("_nth") + 1).cast("string"))).otherwise(
        F.col("rsid"))
    return counted.join(totals, "rsid").withColumn("original", F.col("rsid")).withColumn("rsid", name).drop(
        "_nth", "_total")


def duplicated_markers(renamed: DataFrame) -> DataFrame:
    """Old and new name of every renamed marker, one row each."""
    return renamed.filter("rsid <> original").select("original", "rsid", "marker")


def read_marker_subset(geno: DataFrame, markers: DataFrame, wanted: DataFrame) -> DataFrame:
    """Genotypes of the listed rsids; fails when one does not exist."""
    hits = wanted.select("rsid").distinct().join(markers.select("rsid", "marker"), "rsid", "left")
    checked = materialise(hits.select("rsid", F.when(F.col("marker").isNull(), F.raise_error(
        F.concat(F.lit("marker not found: "), F.col("rsid")))).otherwise(F.col("marker")).cast("int").alias("marker")))
    return geno.join(checked, "marker").select("iid", "marker", "rsid", "dosage")


def allele_letters(geno: DataFrame, markers: DataFrame) -> DataFrame:
    """Genotypes as allele letters; a missing call is ``00``."""
    d = F.col("dosage")
    letters = (F.when(d == 2, F.concat("a1", "a1")).when(d == 1, F.concat("a1", "a2"))
               .when(d == 0, F.concat("a2", "a2")).otherwise(F.lit("00")))
    return geno.join(markers.select("marker", "a1", "a2"), "marker").select("iid", "marker", letters.alias("genotype"))


def write_plink(geno: DataFrame, path: str, n_samples: int, layout: str = "parts", n_markers: int | None = None) -> None:
    """Write ``geno(iid, marker, dosage)`` with dense positions as 2-bit codes.

    Rows are range-partitioned by file position; the pair (marker, byte) spreads evenly whatever
    the number of samples per marker. Parts hold whole markers, so for them the range is by marker.
    """
    spark = geno.sparkSession
    spark.dataSource.register(PlinkBed)
    path = qualified(spark, path)
    fs, plain = open_fs(path)
    stride = -(-n_samples // 4)
    rows = geno.select("marker", F.col("iid").alias("pos"), "dosage", F.floor(F.col("iid") / 4).alias("byte"))
    if layout == "single":
        if n_markers is None:
            raise ValueError("a single file needs the number of markers for its size")
        with open(plain, "wb") as f:
            f.write(BED_HEADER)
            f.truncate(3 + stride * n_markers)
        placed = rows.repartitionByRange("marker", "byte")
    else:
        fs.create_dir(plain, recursive=True)
        placed = rows.repartitionByRange("marker")
    (placed.sortWithinPartitions("marker", "pos").select("marker", "pos", "dosage")
     .write.format("plink_bed").option("path", path).option("samples", n_samples).option("layout", layout)
     .mode("append").save())


def synthetic_tables(spark: SparkSession, n_samples: int, n_markers: int) -> tuple[DataFrame, DataFrame]:
    """Marker and sample lines for a matrix without names."""
    bim = spark.range(n_markers).selectExpr(
        "id", "concat_ws('\t', '1', concat('SNP', id), '0', string((id + 1) * 1000), 'A', 'B') as value")
    fam = spark.range(n_samples).selectExpr(
        "id", "concat_ws('\t', concat('IND', id + 1), concat('IND', id + 1), '0', '0', '0', '0') as value")
    return bim, fam


def bim_lines(markers: DataFrame) -> DataFrame:
    return markers.selectExpr("marker as id", "concat_ws('\t', chrom, rsid, cm, pos, a1, a2) as value")


def fam_lines(samples: DataFrame) -> DataFrame:
    return samples.selectExpr("iid as id", "concat_ws('\t', fid, iid_str, father, mother, gender, status) as value")


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines in the order of ``id`` as sorted text parts."""
    lines.repartitionByRange("id").sortWithinPartitions("id").select("value").write.mode("overwrite").text(path)
