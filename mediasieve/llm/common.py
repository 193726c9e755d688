"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_folder, ship_package

SPACES = r"[\x20\x09-\x0D]+"        # fixed: the white space of the text contracts
WORD = r"[^\x20\x09-\x0D]+"         # fixed: a word is a run of anything else
SHIPPED_ROWS = 1_000_000            # a narrow side is broadcast only below this counted bound


BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))    # what a worker and its task hold at once


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A registered table; ships the package to the workers first and keeps Arrow batches small unless the session says otherwise."""
    ship_package(spark)
    if spark.sparkContext.getConf().get(BATCH[0]) is None:
        spark.conf.set(*BATCH)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    folder = scratch_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def small_side(df: DataFrame, rows: int = SHIPPED_ROWS) -> DataFrame:
    """Hint a broadcast when a bounded count proves the side small; else a shuffle join follows."""
    small = df.limit(rows + 1).count() <= rows
    return F.broadcast(df) if small else df.hint("shuffle_hash")


def total_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder exists in the file system its path names."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def slices(batch, column: int, limit: int = 1 << 22):
    """Row ranges of an Arrow batch with at most ``limit`` bytes of text each (one row at least)."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield batch.slice(start)


def give_back() -> None:
    """Return memory that Arrow and the allocator hold unused to the system: workers stay alive between tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc only
    if trim:
        trim(0)


def tidy(run):
    """The map of a partition, after which the worker gives back what it no longer uses."""
    def whole(batches):
        yield from run(batches)
        give_back()

    return whole


def freed(function):
    """The function of a group, after which Arrow gives back what it no longer uses."""
    def run(*tables):
        import pyarrow as pa

        try:
            return function(*tables)
        finally:
            pa.default_memory_pool().release_unused()

    # Spark tells by the number of arguments whether the key is wanted
    count = function.__code__.co_argcount
    return {2: lambda key, a: run(key, a), 3: lambda key, a, b: run(key, a, b)}[count]
