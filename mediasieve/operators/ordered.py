"""Distributed order operations: prefix sums, neighbours and first-k rows.

A window over one hot or missing partition key would send that whole group to a
single task. Everything here works on (group, chunk) instead: a chunk is a range
of the sorted rows, as large as any other; only chunk totals (at most one row per
group and partition) meet in one window, and each chunk is then ordered on its own.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import checkpointed

def join_groups(left: DataFrame, right: DataFrame, by, on=(), how: str = "inner") -> DataFrame:
    """Equi join on group columns, where a NULL group matches itself, and on other keys.

    Null-safe equality is used only for group columns that can be NULL, so that other
    groups keep the partitioning of a plain key.
    """
    keys = [*by, *on]
    can_be_null = {field.name for field in left.schema if field.nullable} & set(by)
    if not can_be_null:
        return left.join(right, keys, how)
    renamed = right.select(*[F.col(c).alias(f"_right_{c}") if c in keys else F.col(c) for c in right.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_right_{c}")) if c in can_be_null else F.col(c) == F.col(f"_right_{c}") for c in keys]
    return left.join(renamed, reduce(and_, same), how).drop(*[f"_right_{c}" for c in keys])


def in_ranges(rows: DataFrame, order) -> DataFrame:
    """The rows with ``_chunk``, the number of the range of ``order`` they fall in, written once.

    Spark draws the range bounds from a sample of the rows themselves, so ranges hold
    about equal numbers of them however the keys crowd. Another evaluation might draw other
    bounds; the checkpoint fixes the numbers for every later read.
    """
    ranged = rows.repartitionByRange(*order).withColumn("_chunk", F.spark_partition_id())
    return checkpointed(ranged)


def running_sums(rows: DataFrame, by, key: str, sums, neighbours: bool = False, ranges: bool = False) -> DataFrame:
    """Sums over all smaller keys of the group, and the group totals.

    ``rows`` holds one row per (group, key); a NULL group is a group and a NULL
    key lies below all others. Adds ``<column>_below`` and ``<column>_total`` for
    every column in ``sums`` and, on request, ``previous_key`` and ``next_key``, and the
    range a row lies in as ``_chunk``.
    The rows are cut into ranges of (group, key); the sums of whole ranges and
    those inside a range add up. A group of any size spreads over ranges, and many small
    groups share one.
    """
    by, sums = list(by), list(sums)
    chunk = [*by, "_chunk"]
    chunked = in_ranges(rows, [*by, key])
    totals = chunked.groupBy(*chunk).agg(
        *[F.sum(name).alias(f"_{name}") for name in sums], F.min(key).alias("_first"), F.max(key).alias("_last"))
    whole = Window.partitionBy(*by)
    between = whole.orderBy("_chunk")
    before = between.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *chunk,
        *[F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_{name}_chunk") for name in sums],
        *[F.sum(f"_{name}").over(whole).alias(f"{name}_total") for name in sums],
        F.lag("_last").over(between).alias("_chunk_previous"), F.lead("_first").over(between).alias("_chunk_next"))
    local = Window.partitionBy(*chunk).orderBy(key)
    local_before = local.rowsBetween(Window.unboundedPreceding, -1)
    # Joined first: the windows leave the rows partitioned by (group, range), which later steps can use.
    inside = join_groups(chunked, offsets, by, ["_chunk"]).select(
        "*",
        *[F.coalesce(F.sum(name).over(local_before), F.lit(0)).alias(f"_{name}_inside") for name in sums],
        *([F.lag(key).over(local).alias("_lag"), F.lead(key).over(local).alias("_lead")] if neighbours else []))
    below = [(F.col(f"_{name}_chunk") + F.col(f"_{name}_inside")).alias(f"{name}_below") for name in sums]
    extra = []
    if neighbours:
        extra = [F.coalesce("_lag", "_chunk_previous").alias("previous_key"), F.coalesce("_lead", "_chunk_next").alias("next_key")]
    if ranges:
        extra.append(F.col("_chunk"))
    return inside.select(*rows.columns, *below, *[F.col(f"{name}_total") for name in sums], *extra)


def _pairs_of_partition(by: list[str]):
    """Rows by rising key, reduced to one per group: sums, and pairs won less pairs lost among them."""
    def run(batches):
        known, firsts, won, held = {}, [], np.zeros(0), np.zeros((4, 0), np.int64)     # both sums, and how many values entered each
        for batch in batches:
            groups, counts = batch.select(list(range(len(by)))), [batch.column(len(by)), batch.column(len(by) + 1)]
            code = np.zeros(batch.num_rows, np.int64)
            for column in groups.columns:
                each = column.dictionary_encode(null_encoding="encode")
                code = np.unique(code * max(1, len(each.dictionary)) + each.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.diff(code[order], prepend=-1))
            sizes = np.diff(np.append(starts, len(order)))
            values = [c.fill_null(0).to_numpy(zero_copy_only=False)[order] for c in counts]
            valid = [c.is_valid().to_numpy(zero_copy_only=False)[order].astype(np.int64) for c in counts]
            below = [e - v - np.repeat((e - v)[starts], sizes) for v in values for e in [np.cumsum(v)]]
            if not len(order):
                continue
            sums = np.array([np.add.reduceat(v, starts) for v in (*values, *valid)])
            inside = np.add.reduceat(values[0].astype(float) * below[1] - values[1].astype(float) * below[0], starts)
            at = order[starts]
            # a missing or undefined name equals itself
            names = list(zip(*[["nan" if x != x else (x,) for x in c.take(pa.array(at)).to_pylist()] for c in groups.columns])) if by else [()]
            fresh = [i for i, name in enumerate(names) if name not in known]
            place = np.array([known.setdefault(name, len(known)) for name in names])
            if fresh:
                firsts.append(batch.take(pa.array(at[fresh])))
                won, held = np.append(won, np.zeros(len(fresh))), np.hstack([held, np.zeros((4, len(fresh)), np.int64)])
            won[place] += inside + sums[0].astype(float) * held[1, place] - sums[1].astype(float) * held[0, place]
            held[:, place] += sums
        if firsts:
            table = pa.Table.from_batches(firsts).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays(
                [*[table.column(i) for i in range(len(by))], *[pa.array(held[i], mask=held[2 + i] == 0) for i in range(2)],
                 pa.array(won), pa.array(np.full(len(won), TaskContext.get().partitionId(), np.int64))], [*by, "a", "b", "_pairs", "_range"])

    return run


def pair_sums(cells: DataFrame, by, key: str, a: str, b: str) -> DataFrame:
    """Per group and range of (group, key): the sums of two counts and, over pairs of keys in it, a above b less b above a.

    ``cells`` holds one row per (group, key). A range is sorted by key alone and leaves one row per group it holds,
    with the range's number as ``_range``: rows meet no window and are written nowhere.
    """
    by = list(by)
    ordered = cells.repartitionByRange(*by, key).sortWithinPartitions(key).select(*by, F.col(a).cast("long").alias(a), F.col(b).cast("long").alias(b))
    schema = StructType([ordered.schema[name] for name in by]).add("a", "long").add("b", "long").add("_pairs", "double").add("_range", "long")
    return ordered.mapInArrow(_pairs_of_partition(by), schema).withColumnsRenamed({"a": a, "b": b})


def first_rows(df: DataFrame, by, bucket: Column, order, k: int, keep_all_up_to: int | None = None,
               counted: Column | None = None) -> DataFrame:
    """The first ``k`` rows of every group in (bucket, order), exactly.

    ``bucket`` is a coarse order (file name, leading hash bits) whose rows are
    bounded in number. Bucket counts drop the buckets that lie wholly behind the
    k-th row before anything is shuffled; the rest is ranked bucket by bucket.
    ``keep_all_up_to`` keeps everything when the whole frame is that small.
    With ``counted`` only rows it holds for count towards ``k``: a row stays
    while fewer than ``k`` counted rows come before it. ``df`` is read twice.
    """
    by = list(by)
    one = F.lit(1) if counted is None else F.coalesce(counted.cast("int"), F.lit(0))
    marked = df.withColumn("_bucket", bucket).withColumn("_one", one)
    counts = marked.groupBy(*by, "_bucket").agg(F.sum("_one").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = counts.select(
        *by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy()).alias("_all"))
    everything = F.lit(False) if keep_all_up_to is None else F.col("_all") <= keep_all_up_to
    keyed = join_groups(marked, plan.where(everything | (F.col("_before") < k)), by, ["_bucket"])
    local = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("_before") + F.coalesce(F.sum("_one").over(local), F.lit(0))
    return keyed.withColumn("_ahead", ahead).where(everything | (F.col("_ahead") < k)).select(*df.columns)


def dense_index(df: DataFrame, by, bucket: Column, order, name: str = "idx") -> DataFrame:
    """A gap-free 0-based position per group in (bucket, order)."""
    by = list(by)
    marked = df.withColumn("_bucket", bucket)
    counts = marked.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order))
    return (join_groups(marked.withColumn("_rank", rank), offsets, by, ["_bucket"])
            .withColumn(name, (F.col("_before") + F.col("_rank") - 1).cast("bigint"))
            .select(*df.columns, name))
