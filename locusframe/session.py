"""Session helpers: Spark settings, shared scratch tables, size-checked collects."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Largest matrix side that is solved on the driver (a 4096 x 4096 double matrix is 128 MB).
MAX_DRIVER_SIDE = 4096


def build_session(app: str = "locusframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on; cluster settings stay with spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.python.filterPushdown.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where that is unset, a folder on the default file system of a cluster; a local run may use a temporary folder, a cluster
    whose default file system is local may not.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        default = context._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(context._jsc.hadoopConfiguration()).toString()
        if not default.startswith("file:"):
            root = f"{default.rstrip('/')}/tmp/locusframe-{context.applicationId}"
        elif context.master.startswith("local"):
            root = tempfile.mkdtemp(prefix="locusframe-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme of the file system that Spark itself would resolve it against."""
    context = spark.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


@contextmanager
def _shuffles_removed(spark: SparkSession):
    """Spark removes the shuffle files of a query that runs in here when it ends: its result is stored, nothing reads them again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    if before is not None:
        spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is not None:
            spark.conf.set(name, before)


def materialise(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``df`` to a scratch table and read it back; with ``folder``, its last column, each value of that has a folder of its own.

    It cuts the lineage on shared storage, so a lost executor costs no recomputation, and gives
    Spark the true size of the table: whether it is broadcast or sort-merge joined then follows
    from ``spark.sql.autoBroadcastJoinThreshold`` and not from a hint.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        (df.write.partitionBy(folder) if folder else df.write).parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._scratch_path = path
    return stored


def discard(*stored: DataFrame) -> None:
    """Remove scratch tables that no later step reads, for instance the previous state of an iteration."""
    for df in stored:
        path = getattr(df, "_scratch_path", None)
        if path:
            context = df.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def collect_bounded(df: DataFrame, limit: int, what: str) -> list:
    """Collect at most ``limit`` rows; more than that is an error and never a truncation."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows would reach the driver")
    return rows
