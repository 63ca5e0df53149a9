"""Session helpers: table access, shared scratch folder, size-checked broadcast."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Largest side that is ever broadcast on purpose (rows, after the check below).
BROADCAST_ROWS = 200_000

#: What ``spread`` puts into a partition (bytes of the scan, as Parquet has them).
SPREAD_BYTES = 16 * 1024 * 1024

#: Whether shuffle files go at the end of a query.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Applications that have the package.
_SHIPPED: set[str] = set()


def local_session(cores: int | str = 8, **conf) -> SparkSession:
    """A local session for tests and benchmarks (a cluster brings its own)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("textloom")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        # A hash join where the measured partitions of one side are small enough.
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "128MB")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in every Python worker.

    Functions are pickled by reference, so workers need the package, wherever
    the driver was started.  It is sent once per application.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    # The driver serves the file as long as the application runs.
    folder = tempfile.mkdtemp(prefix="textloom-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(os.path.join(folder, "textloom_package"), "zip", root, "textloom"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session
    without that setting gets a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="textloom-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path inside the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A setting of the session that holds for what is run in here."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def one_use_shuffles(spark: SparkSession):
    """Spark deletes the shuffle files of frames that are made and run in here once they have run.

    Otherwise they lie on the executors' disks until the driver happens to collect its garbage.
    """
    return setting(spark, CLEANUP, "true")


def densely_written(spark: SparkSession):
    """Tables written in here take a third less disk than with the usual compression, and somewhat more time."""
    return setting(spark, "spark.sql.parquet.compression.codec", "zstd")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back.

    The table survives the loss of any executor, is computed once however
    often it is used, and keeps the statistics and column pruning of Parquet.
    """
    path = scratch_path(df.sparkSession, label)
    with one_use_shuffles(df.sparkSession):
        df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._textloom_path = path
    return written


def release(table: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote and that nothing reads any more."""
    path = getattr(table, "_textloom_path", None)
    if path is not None:
        session = table.sparkSession
        target = session._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(session._jsc.hadoopConfiguration()).delete(target, True)


def broadcast_checked(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only when a count proves the side small; otherwise leave
    the join strategy to the optimizer, which shuffles both sides."""
    return F.broadcast(df) if df.count() <= max_rows else df


def spread_small(df: DataFrame, key: str) -> DataFrame:
    """Hash-spread a scan that is too small to give every core a split.

    One small Parquet file is one task, however many cores there are.  The
    plan's own size estimate decides; input that already fills the cores is
    returned untouched, so nothing is shuffled at scale.  A partition gets
    ``SPREAD_BYTES`` at most, unless one key has more: what is grouped by the
    key afterwards stays in these partitions.
    """
    split = 128 * 1024 * 1024
    return spread(df, key) if plan_bytes(df) < df.sparkSession.sparkContext.defaultParallelism * split else df


def plan_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-spread by a key, over every core and into partitions that do not grow with the table."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-plan_bytes(df) // SPREAD_BYTES)), key)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
