"""Exact duplicates by progressive refinement, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, materialize, small_side, text_of

PREFIX = 64                 # characters under the second key
BUCKET = 32_768             # fixed: bits of one row of Spark's bitmaps
MOST_BITS = 1 << 28         # of a bitmap of shared keys, which then has 32 MB
SHIPPED_GROUPS = 200_000    # groups of copies are broadcast only below this counted bound


def squeezed(text_col: str = "text") -> Column:
    """The text with each run of white space as one space; null is empty."""
    return F.regexp_replace(text_of(text_col), SPACES, " ")


def bits_of(keys: DataFrame, name: str, most_bits: int) -> tuple[DataFrame, int]:
    """A bitmap of the places of ``keys`` (``_hash64``): rows (``_bucket``, ``_bits``) of 4 KB, at most ``most_bits`` bits in all."""
    keys = materialize(keys, name)
    bits = max(BUCKET, min(most_bits, 1 << (16 * keys.count()).bit_length()))
    place = _place(bits)
    return keys.groupBy(F.bitmap_bucket_number(place).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits")), bits


def _place(bits: int) -> Column:
    return F.pmod(F.col("_hash64"), F.lit(bits)) + 1


def maybe_held(rows: DataFrame, bitmap: DataFrame, bits: int) -> DataFrame:
    """``_maybe``: false for rows whose ``_hash64`` is surely not among the keys; the bitmap is bounded, so it is broadcast."""
    place = _place(bits)
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    met = rows.withColumns({"_bucket": F.bitmap_bucket_number(place), "_at": at}).join(F.broadcast(bitmap), "_bucket", "left")
    bit = F.expr("cast(1 as int)") * F.pow(F.lit(2), F.col("_at") % 8).cast("int")
    return met.withColumn("_maybe", F.coalesce(byte.bitwiseAND(bit) != 0, F.lit(False))).drop("_bucket", "_bits", "_at")


def _shared(keys: DataFrame) -> DataFrame:
    """Keys that more than one row has."""
    return keys.groupBy("_hash64").agg(F.count("*").alias("_n")).filter("_n > 1").select("_hash64")


def refined(rows: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """``rows`` (``_text`` and others) with ``_hash``: SHA-256 where length and then prefix are shared with another row.

    Three rounds, each over the rows that the one before left: the length of every row, the prefix hash of
    rows whose length is shared, the full hash of rows whose length and prefix
    are. Shared keys come back to the texts as a bitmap of bounded size; a
    place that two keys take lets a row into the next round needlessly and changes nothing else.
    """
    length = rows.withColumn("_hash64", F.xxhash64(F.length("_text")))
    lengths, n_lengths = bits_of(_shared(length.select("_hash64")), "shared_lengths", most_bits)
    long = maybe_held(length, lengths, n_lengths)
    prefix = F.xxhash64(F.length("_text"), F.substring("_text", 1, PREFIX))
    prefixes, n_prefixes = bits_of(_shared(long.filter("_maybe").select(prefix.alias("_hash64"))), "shared_prefixes", most_bits)
    last = maybe_held(long.withColumn("_hash64", F.when(F.col("_maybe"), prefix)), prefixes, n_prefixes)
    return last.withColumn("_hash", F.when(F.col("_maybe"), F.sha2("_text", 256))).drop("_hash64", "_maybe")


def _marked(docs: DataFrame, id_col: str, text_col: str, carry, most_bits: int) -> DataFrame:
    """``_id``, ``_carry_*``, ``_keep_id``, ``_group_size``, ``_kept``."""
    carried = [f"_carry_{c}" for c in carry]
    rows = docs.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_carry_{c}") for c in carry],
                       squeezed(text_col).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    order = F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_row").alias("row"))
    # row numbers are those of one scan: both sides of the join read the rows written here
    keyed = materialize(refined(rows, most_bits).select("_id", *carried, order.alias("_order"), "_hash"), "keyed")
    groups = (keyed.filter("_hash is not null").groupBy(F.col("_hash").alias("_key"))
              .agg(F.min("_order").alias("_first"), F.count("*").alias("_n")).filter("_n > 1"))
    groups = materialize(groups, "copies")
    # a row alone in its length and prefix gets a key of its own, so nulls don't meet in one task
    keyed = keyed.withColumn("_key", F.coalesce("_hash", F.col("_order.row").cast("string")))
    return keyed.join(small_side(groups, SHIPPED_GROUPS), "_key", "left").select(
        "_id", *carried, F.when(F.col("_first").isNull(), F.col("_id")).otherwise(F.col("_first.id")).alias("_keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("_group_size"),
        (F.col("_first").isNull() | (F.col("_first") == F.col("_order"))).alias("_kept"))


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (),
                    most_bits: int = MOST_BITS) -> DataFrame:
    """One row per input row: ``id_col``, ``carry``, ``keep_id``, ``group_size``, ``kept``.

    Texts are equal when identical after squeezing white space; null counts as
    empty. Three rounds: the length, the hash of the first characters, the full
    SHA-256, which is computed for rows whose first two keys are shared (see
    ``refined``). Texts never cross a shuffle, at any size. The smallest id of a
    group stays, null ids sort last; of rows that repeat the id as well, the
    first one read stays. Rows, their numbers and ``carry`` are written once and
    read from there, since another scan may cut files elsewhere and number rows
    anew. An empty table gives no rows.
    """
    marked = _marked(docs, id_col, text_col, carry, most_bits)
    return marked.select(F.col("_id").alias(id_col), *[F.col(f"_carry_{c}").alias(c) for c in carry],
                         F.col("_keep_id").alias("keep_id"), F.col("_group_size").alias("group_size"), F.col("_kept").alias("kept"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    most_bits: int = MOST_BITS) -> DataFrame:
    """The rows that ``mark_duplicates`` keeps, with their columns, whatever they are called."""
    marked = _marked(docs, id_col, text_col, [c for c in docs.columns if c != id_col], most_bits).filter("_kept")
    return marked.select(*[F.col("_id" if c == id_col else f"_carry_{c}").alias(c) for c in docs.columns])
