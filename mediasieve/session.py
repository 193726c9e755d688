"""Session defaults and the two helpers that decide how data is materialised."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from multiprocessing.pool import ThreadPool
from pathlib import Path

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only after a count proves it has at most this many rows.
BROADCAST_ROWS = 200_000


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  name: str = "mediasieve") -> SparkSession:
    """A session with adaptive execution, Arrow and UTC; cluster settings win."""
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


# What a Python worker and its task hold at once: rows may be pictures or texts, so their number says little.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in bytes unless the application was started with a bound of its own."""
    if spark.sparkContext.getConf().get(BATCH[0]) is None:
        spark.conf.set(*BATCH)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, as ``--py-files`` does; once per application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="mediasieve-")) / package.name
        context.addPyFile(shutil.make_archive(str(target), "zip", package.parent, package.name))
        _SHIPPED.add(context.applicationId)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder the session names.

    A temporary folder is used only on a local master, where every task shares
    the machine; on a cluster a missing ``spark.checkpoint.dir`` is an error.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, taken from the session and set once."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="mediasieve-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder for a table that is written and read back."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written once as Parquet in the shared folder: a checkpoint for frames that are read many times."""
    path = scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Repartition a plain scan that has fewer tasks than the session has cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def in_parallel(spark: SparkSession, tasks, threads: int = 5) -> list:
    """Run independent driver calls (model fits, checks) side by side, results in order."""
    with ThreadPool(max(1, min(threads, len(tasks)))) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda task: task()), tasks)


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when a bounded count shows ``df`` has at most ``max_rows`` rows."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only for a side of proven size, else leave it to AQE."""
    return F.broadcast(df) if fits_broadcast(df, max_rows) else df
