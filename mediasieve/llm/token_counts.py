"""Token counts through a digest cache: only contents the cache lacks are encoded."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHIPPED_ROWS, materialize, path_exists, slices, small_side, text_of
from .tokens import shared_encoder, file_digest

CACHE = "content_digest string, tokenizer_digest string, n_tokens long"


def read_cache(spark, path: str, version: str) -> DataFrame:
    """Counts stored for one tokenizer version, each content once; none if there is no cache yet."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], CACHE)
    rows = spark.read.schema(CACHE).parquet(path).filter(F.col("tokenizer_digest") == version)
    return rows.groupBy("content_digest", "tokenizer_digest").agg(F.max("n_tokens").alias("n_tokens"))


def _encode(path: str, kind: str):
    def run(batches):
        encoder = shared_encoder(path, kind)
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(encoder.counts(part.column(1)), pa.int64())], ["content_digest", "n_tokens"])

    return run


def misses(ids: DataFrame, cache: DataFrame) -> DataFrame:
    """One representative row (id, digest) of each content that the cache lacks."""
    found = ids.groupBy("content_digest").agg(F.min("_id").alias("_id"))
    return found.join(cache.select("content_digest"), "content_digest", "left_anti")


def fill_cache(docs: DataFrame, ids: DataFrame, tokenizer: str, cache: str, kind: str,
               text_col: str = "text", ship_rows: int = SHIPPED_ROWS) -> str:
    """Encode the distinct misses and append them; returns the tokenizer version.

    The smaller of the rows to encode and the rows to skip is joined to the
    texts: broadcast when counted small, else by a hash join on the digest.
    """
    spark, version = docs.sparkSession, file_digest(tokenizer)
    todo = materialize(misses(ids, read_cache(spark, cache, version)), "misses")
    n_todo, n_all = todo.count(), ids.count()
    if n_todo == 0:
        return version
    keys = ["content_digest", "_id"]
    texts = docs.select(F.sha2(text_of(text_col), 256).alias("content_digest"), F.col("_id"), text_of(text_col).alias("_text"))
    if 2 * n_todo <= n_all:
        side, how = todo, "left_semi"
    else:
        side, how = ids.join(todo, _same(ids, todo, keys), "left_anti").select(*keys), "left_anti"
    side = small_side(side, ship_rows)
    picked = texts.join(side, _same(texts, side, keys), how).select("content_digest", "_text")
    counted = picked.mapInArrow(_encode(tokenizer, kind), "content_digest string, n_tokens long")
    (counted.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
     .select("content_digest", F.lit(version).alias("tokenizer_digest"), "n_tokens")
     .write.mode("append").parquet(cache))
    return version


def _same(left: DataFrame, right: DataFrame, keys):
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, kind: str = "bytes", id_col: str = "doc_id",
                 text_col: str = "text", ship_rows: int = SHIPPED_ROWS) -> DataFrame:
    """One row per document: ``id_col``, ``n_bytes``, ``n_tokens``, ``content_digest``.

    A content is the whole text (byte-level pieces depend on every space, so only
    null is normalised, to empty). Its SHA-256 and the digest of the tokenizer
    file are the cache key; the cache is a Parquet folder that only grows.
    Copies, repeated rows and rows with a null id get the count of their content;
    an empty table gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias(text_col))
    ids = materialize(docs.select("_id", F.sha2(text_of(text_col), 256).alias("content_digest"),
                                  F.octet_length(text_of(text_col)).cast("long").alias("n_bytes")), "digests")
    version = fill_cache(docs, ids, tokenizer, cache, kind, text_col, ship_rows)
    stored = read_cache(docs.sparkSession, cache, version).select("content_digest", "n_tokens")
    return (ids.join(stored, "content_digest", "left")
            .select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", "content_digest"))
