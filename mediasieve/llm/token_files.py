"""Token ids in ORC files: integer run-length encoded stripes, row indexes, Bloom filters on ids."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices, text_of
from .tokens import shared_encoder

FILES = "shard int, position long, doc_id long, n_tokens long, ids array<int>"
OPTIONS = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true",
           "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20), "compression": "zstd"}


def _encode(tokenizer: str, kind: str, end_id: int | None):
    def run(batches):
        encoder, shard, position = shared_encoder(tokenizer, kind), TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, 1):
                flat, at = encoder.encode(part.column(1), end_id)
                n = len(at) - 1
                ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(position, position + n)), part.column(0),
                     pa.array(np.diff(at)), ids], ["shard", "position", "doc_id", "n_tokens", "ids"])
                position += n

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, kind: str = "words", end_id: int | None = 1,
                      id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write each document's ids, in ascending id order over the files (null ids last).

    Rows are dealt by ranges of (id, content hash), so repeated or null ids
    spread over files too; ties are in content-hash order. ``shard`` and
    ``position`` state the order, whatever the file names are. Null texts are
    empty; an empty table gives a folder without rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"),
                       F.xxhash64(text_of(text_col)).alias("tie"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie").asc()]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    sorted_rows.mapInArrow(_encode(tokenizer, kind, end_id), FILES).write.options(**OPTIONS).orc(path)


def read_token_files(spark: SparkSession, path: str, doc_ids=None) -> DataFrame:
    """The files as rows; ``doc_ids`` is a filter that stripe statistics and Bloom filters prune by."""
    rows = spark.read.schema(FILES).orc(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(*doc_ids))


def _checksums(batches):
    for batch in batches:
        lists = batch.column(3)
        at = lists.offsets.to_numpy()
        values = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        sums = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(np.diff(at), pa.int64()), pa.array(sums, pa.int64())],
            ["shard", "position", "doc_id", "n_tokens", "ids_crc32"])


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` read back from the files.

    ``start`` adds the ids of the shards before (one narrow row per shard) and of
    the rows before in the same shard; no window holds more than one shard's rows.
    """
    rows = (read_token_files(spark, path).select("shard", "position", "doc_id", "ids")
            .mapInArrow(_checksums, "shard int, position long, doc_id long, n_tokens long, ids_crc32 long"))
    sums = read_token_files(spark, path).groupBy("shard").agg(F.sum("n_tokens").alias("_in_shard"))      # reads no ids
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("shard", F.coalesce(F.sum("_in_shard").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("shard").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    return (rows.withColumn("_before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
            .join(bases, "shard")
            .select("doc_id", (F.col("_base") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32"))
