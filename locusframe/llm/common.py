"""Helpers shared by the operators: tables, shared scratch tables, Arrow slices, the held-out rule."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.session import materialise  # noqa: F401  (scratch tables in spark.checkpoint.dir)

# Rows and bytes of text that a worker turns into Python objects at a time.
SLICE_ROWS, SLICE_BYTES = 512, 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Bytes of the batches in which texts go to Python workers, in buffers of the executor and of the worker.
BATCH_BYTES = 8 << 20


def bounded_batches(docs: DataFrame) -> DataFrame:
    """``docs``, after setting its session to batches of bounded bytes: thousands of long texts in one batch would take much memory twice."""
    spark, name = docs.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(name, None)).lower().removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    return docs


def text_slices(texts: pa.Array) -> Iterator[list[str]]:
    """The texts of an Arrow array as lists of bounded size; null becomes the empty text."""
    mean = max(1, texts.nbytes // max(1, len(texts)))
    step = max(1, min(SLICE_ROWS, SLICE_BYTES // mean))
    for at in range(0, len(texts), step):
        yield [t or "" for t in texts.slice(at, step).to_pylist()]
    _trim()  # a worker that waits for its next batch, or for another stage, holds no free memory


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the rows whose crc32 of the id's text is divisible by five (null ids: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def stable_order(doc_id: str = "doc_id", seed: int = 0) -> Column:
    """A fixed pseudo-random number per id, for bounded samples that don't depend on the file layout."""
    return F.xxhash64(F.lit(seed), F.col(doc_id))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, sample: int) -> DataFrame:
    """Rows ``text, y`` to fit a classifier on: at most ``sample`` labelled ids that aren't held out, with their texts.

    The ids are those first in a fixed pseudo-random order. Ids that are null, and labels that are null, not 0 or 1 or
    contradict each other, are left out. The ids are few by construction, so they are broadcast and no text is shuffled.
    """
    known = (labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & ~held_out())
             .groupBy("doc_id").agg(F.min(column).cast("long").alias("y"), F.max(column).alias("_other")).where("y = _other"))
    ids = materialise(known.orderBy(stable_order(), "doc_id").limit(sample).select("doc_id", "y"))
    return bounded_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id").select("text", "y")


def per_process(use: str, key: tuple, make: Callable[[], object], version: str = ""):
    """One object per Python process and key, such as a compiled vocabulary; another ``version`` takes the place of the one before.

    A process keeps the objects of one ``use`` only: the first object of another use, as in the next stage of a pipeline,
    releases them all. The package's functions travel to workers by value, globals and all, so what a worker shall keep from task to
    task is held by a module object of the process instead.
    """
    kept = sys.modules.setdefault("_kept_by_workers", types.ModuleType("_kept_by_workers")).__dict__
    if kept.get("use") != use:
        for old in [k for k in kept if isinstance(k, tuple)]:
            del kept[old]
        kept["use"] = use
        _give_back()
    if key not in kept or kept[key][0] != version:
        kept.pop(key, None)
        kept[key] = (version, make())
        _give_back()  # what was only needed to make it
    return kept[key][1]


def _give_back() -> None:
    gc.collect()
    _trim()


def _trim() -> None:
    """Return freed memory to the system, where its C library can do that."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass
