"""Mix sources to target weights: Sainte-Lague quotas of equal-token blocks, built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, WORD, materialize, small_side, text_of

BLOCK = 8                   # words in a block
SHARD_ROWS = 4000           # documents of one source in a shard, about
REPEATS = 3                 # a document is taken at most so often
WEIGHTS = (5, 2, 1)         # by source in code point order, repeating


def word_count(text_col: str = "text") -> Column:
    """Words of the text; null has none."""
    return F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long")


def seeded(id_col: str, seed: int) -> Column:
    """A hash that orders documents, the same in every run (null ids as empty)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def targets(sources: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Adds ``_target`` to one row per source (``_source``, ``_size``): weighted shares with a ceiling.

    The source with the smallest ceiling per weight fills first; once the rest
    of the total, shared by weight, lies under the next ceiling, it is final.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_at") % len(weights) + 1).cast("int"))
    placed = (sources.withColumn("_at", F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1)
              .withColumn("_weight", weight.cast("long")).withColumn("_ceiling", F.col("_size") * repeats))
    order = Window.orderBy((F.col("_ceiling") / F.col("_weight")).asc(), F.col("_at").asc())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    filled = placed.withColumns({
        "_total": F.sum("_size").over(whole), "_weights": F.sum("_weight").over(whole),
        "_full": F.coalesce(F.sum("_ceiling").over(before), F.lit(0)),
        "_full_weight": F.coalesce(F.sum("_weight").over(before), F.lit(0))})
    # the filled ones come first in this order: ceiling x left weight <= left total x weight
    filled = filled.withColumn("_capped", F.col("_ceiling").cast("decimal(38,0)") * (F.col("_weights") - F.col("_full_weight"))
                               <= (F.col("_total") - F.col("_full")).cast("decimal(38,0)") * F.col("_weight"))
    filled = filled.withColumns({
        "_left": F.col("_total") - F.coalesce(F.sum(F.when(F.col("_capped"), F.col("_ceiling"))).over(whole), F.lit(0)),
        "_left_weight": F.col("_weights") - F.coalesce(F.sum(F.when(F.col("_capped"), F.col("_weight"))).over(whole), F.lit(0))})
    share = F.col("_left").cast("double") * F.col("_weight").cast("double") / F.nullif("_left_weight", F.lit(0)).cast("double")
    return filled.withColumn("_target", F.when(F.col("_capped"), F.col("_ceiling").cast("double")).otherwise(share))


def sainte_lague(parties: DataFrame, votes: str, seats: str, total: str, by: list[str], order: list[str]) -> DataFrame:
    """Adds ``quota``: ``seats`` seats to the parties of each group ``by`` by the highest votes / (2 s + 1).

    ``total`` are the votes of the group, ``order`` breaks ties. Seats that every
    divisor method step up to a safe divisor gives are assigned at once; only
    the last ones, at most about one per party, are ranked by their quotients. The
    columns ``by`` and ``order`` are a key without nulls.
    """
    group = Window.partitionBy(*by)
    counted = parties.withColumn("_parties", F.count("*").over(group))
    half = F.col("_parties") / F.lit(2.0)
    few = F.col(seats) <= half
    low = F.when(few | (F.col(votes) <= 0), 0).otherwise(
        F.floor(F.col(votes) * (F.col(seats) - half) / F.col(total) + 0.5 - 1e-9)).cast("long")
    high = F.when(F.col(votes) <= 0, 0).otherwise(
        F.ceil(F.col(votes) * (F.col(seats) + half + 1) / F.col(total) + 0.5)).cast("long")
    counted = counted.withColumns({"_low": low, "_high": high})
    counted = counted.withColumn("_open", F.col(seats) - F.sum("_low").over(group))
    candidates = (counted.filter("_high > _low")
                  .select(*by, *order, "_open", F.col(votes).alias("_votes"), F.explode(F.expr("sequence(_low, _high - 1)")).alias("_seat"))
                  .withColumn("_quotient", F.col("_votes") / (2 * F.col("_seat") + 1)))
    rank = Window.partitionBy(*by).orderBy(F.col("_quotient").desc(), *[F.col(c).asc_nulls_last() for c in order], "_seat")
    won = (candidates.withColumn("_rank", F.row_number().over(rank)).filter("_rank <= _open")
           .groupBy(*by, *order).agg(F.count("*").alias("_won")))
    return counted.join(won, by + order, "left").select(
        *parties.columns, (F.col("_low") + F.coalesce("_won", F.lit(0))).alias("quota"))


def _mixed(docs: DataFrame, weights=WEIGHTS, seed: int = 7, block: int = BLOCK, repeats: int = REPEATS, shard_rows: int = SHARD_ROWS,
           id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """``_id``, ``_carry_*``, ``_length``, ``_source_size``, ``_target``, ``_taken``."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), word_count(text_col).alias("_length"),
                       seeded(id_col, seed).alias("_hash"), *[F.col(c).alias(f"_carry_{c}") for c in carry])
    if not carry:
        rows = materialize(rows, "sizes")
    sources = rows.groupBy("_source").agg(F.sum("_length").alias("_size"), F.count("*").alias("_rows"))
    shared = targets(sources, weights, repeats).withColumns({
        "_blocks": F.floor(F.col("_total") / F.lit(block)).cast("long"), "_everything": F.col("_total").cast("double")})
    seated = sainte_lague(shared.withColumn("_one", F.lit(1)), "_target", "_blocks", "_everything", ["_one"], ["_at"])
    plan = materialize(seated.select(
        "_source", "_at", "_target", F.col("_size").alias("_source_size"),
        F.greatest(F.lit(1), F.ceil(F.col("_rows") / F.lit(shard_rows))).cast("long").alias("_shards"),
        F.least("quota", F.floor(F.col("_ceiling") / F.lit(block))).cast("long").alias("_quota")), "quotas")
    number = F.conv(F.substring("_hash", 1, 8), 16, 10).cast("long")
    dealt = rows.join(small_side(plan), rows["_source"].eqNullSafe(plan["_source"])).select(
        *[rows[c] for c in rows.columns if c != "_source"], "_at", "_target", "_source_size", "_quota",
        (number % F.col("_shards")).alias("_shard"))
    shards = dealt.groupBy("_at", "_shard").agg(
        F.sum("_length").alias("_shard_size"), F.first("_quota").alias("_quota"),
        F.first("_source_size").cast("double").alias("_votes_all"))
    shards = shards.withColumn("_votes", F.col("_shard_size").cast("double"))
    quotas = sainte_lague(shards, "_votes", "_quota", "_votes_all", ["_at"], ["_shard"]).select(
        "_at", "_shard", "_shard_size",
        F.least(F.col("quota") * block, F.col("_shard_size") * repeats).alias("_words"))
    laid = Window.partitionBy("_at", "_shard").orderBy("_hash", "_id", "_length").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_start", F.coalesce(F.sum("_length").over(laid), F.lit(0))).join(quotas, ["_at", "_shard"], "left")
    shard_size = F.nullif("_shard_size", F.lit(0))
    whole = F.floor(F.col("_words") / shard_size).cast("long")
    part = F.least(F.greatest(F.col("_words") % shard_size - F.col("_start"), F.lit(0)), F.col("_length"))
    return placed.select("_id", *[f"_carry_{c}" for c in carry], "_length", "_source_size", "_target",
                         F.coalesce(whole * F.col("_length") + part, F.lit(0)).cast("long").alias("_taken"))


def mix(docs: DataFrame, weights=WEIGHTS, seed: int = 7, block: int = BLOCK, repeats: int = REPEATS, shard_rows: int = SHARD_ROWS,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, ``carry``, ``size``, ``source_size``, ``target``, ``taken``.

    Blocks of ``block`` words go to sources by highest quotients of their targets,
    then to a source's shards by those of their sizes. A shard lays its documents
    out in seeded order, up to ``repeats`` times in a row, and takes its first
    blocks: so each document is taken some whole times and at most one per shard
    in part. Sources, also the null source, are split into shards by seeded hash.
    Empty and null texts take nothing; rows that repeat an id lie side by side;
    an empty table gives no rows. Texts cross no shuffle unless carried.
    """
    mixed = _mixed(docs, weights, seed, block, repeats, shard_rows, id_col, text_col, source_col, carry)
    return mixed.select(F.col("_id").alias(id_col), *[F.col(f"_carry_{c}").alias(c) for c in carry], F.col("_length").alias("size"),
                        F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mix as documents: a row per whole taking, and one with the first words where a part is taken.

    Rows of a document repeat its id. A cut text joins its words by single
    spaces; ``n_chars``, where the table has it, follows the cut text.
    """
    names = [c for c in docs.columns if c != id_col]
    mixed = _mixed(docs, id_col=id_col, text_col=text_col, carry=tuple(names), **options).filter("_taken > 0")
    copies = mixed.withColumn("_copy", F.explode(F.expr("sequence(1, cast(ceil(_taken / _length) as int))")))
    words = F.least("_length", F.col("_taken") - (F.col("_copy") - 1) * F.col("_length"))
    part, text = words < F.col("_length"), f"_carry_{text_col}"
    cut = F.array_join(F.slice(F.split(F.regexp_replace(text_of(text), rf"^{SPACES}", ""), SPACES), 1, words.cast("int")), " ")
    texts = copies.withColumn("_part", part).withColumn(text, F.when(part, cut).otherwise(F.col(text)))
    if "n_chars" in names:
        texts = texts.withColumn("_carry_n_chars", F.when(F.col("_part"), F.length(text).cast("long")).otherwise(F.col("_carry_n_chars")))
    return texts.select(*[F.col("_id" if c == id_col else f"_carry_{c}").alias(c) for c in docs.columns])
