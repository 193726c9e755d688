"""Pooled target geometry and the canonical crop-and-resize plan."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from .ordered import dense_index

# Fixed value: JPEG qualities of canonical images, both ends included.
JPEG_QUALITY = (75, 96)


def pool_targets(staged: DataFrame) -> DataFrame:
    """(pool, idx, ar, se): every positive size of a pool, densely numbered.

    The order is (dataset, file, row), so a position does not depend on how the
    rows were read. The pool is an indexed table, not one array, because it grows
    with the corpus.
    """
    sized = staged.where("width > 0 AND height > 0")
    place = F.concat_ws("/", "dataset", "file")
    numbered = dense_index(sized.select("pool", "dataset", "file", "row", "raw_id", "width", "height"),
                           ["pool"], place, ["row", "raw_id"])
    return numbered.select("pool", "idx", (F.col("width") / F.col("height")).alias("ar"),
                           F.least("width", "height").alias("se"))


def pool_summary(staged: DataFrame) -> DataFrame:
    """Size, medians, bounds and datasets of every pool."""
    sized = staged.where("width > 0 AND height > 0")
    short = F.least("width", "height")
    return sized.groupBy("pool").agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile(F.col("width") / F.col("height"), F.lit(0.5)).alias("ar_median"),
        F.percentile(short, F.lit(0.5)).cast("int").alias("se_median"),
        F.min(short).alias("se_min"), F.max(short).alias("se_max"),
        F.array_sort(F.collect_set("dataset")).alias("datasets"))


def draw_targets(staged: DataFrame, pools: DataFrame, seed: int = 0, sha: str = "raw_sha256") -> DataFrame:
    """Target aspect ratio and short edge drawn from the row's pool by content hash.

    Each draw is an equi join on (pool, idx); draws are spread evenly over the
    pool, so no key is hot even when one pool holds most rows.
    """
    sizes = pools.groupBy("pool").agg((F.max("idx") + 1).alias("_n"))
    key = F.concat(F.lit(f"{seed}:"), F.col(sha))
    spread = F.concat(F.lit(":"), F.col("raw_id"))
    drawn = (staged.join(F.broadcast(sizes), "pool")          # one row per pool of the registry
             .withColumn("_ar_idx", hashing.hex_number(hashing.sha(F.concat(key, F.lit(":ar"), spread)), 1, 15) % F.col("_n"))
             .withColumn("_se_idx", hashing.hex_number(hashing.sha(F.concat(key, F.lit(":se"), spread)), 1, 15) % F.col("_n")))
    ars = pools.select("pool", F.col("idx").alias("_ar_idx"), F.col("ar").alias("target_ar"))
    ses = pools.select("pool", F.col("idx").alias("_se_idx"), F.col("se").alias("target_se"))
    return drawn.join(ars, ["pool", "_ar_idx"]).join(ses, ["pool", "_se_idx"]).drop("_n", "_ar_idx", "_se_idx")


def draw_targets_seeded(staged: DataFrame, pool_sizes: dict[str, int], seed: int = 0,
                        sha: str = "raw_sha256") -> DataFrame:
    """Pool positions ``ar_idx, se_idx`` drawn by a numpy generator seeded per row.

    The generator is seeded with the seed XOR the first 64 bits of the content
    hash. Pool sizes are one number per registry pool.
    """
    if not pool_sizes or min(pool_sizes.values()) < 1:
        raise ValueError("every geometry pool needs at least one decodable image")

    @F.pandas_udf("ar_idx bigint, se_idx bigint")
    def draw(digests: pd.Series, pools: pd.Series) -> pd.DataFrame:
        rows = []
        for digest, pool in zip(digests, pools):
            rng = np.random.default_rng(seed ^ int(digest[:16], 16))
            rows.append((int(rng.integers(0, pool_sizes[pool])), int(rng.integers(0, pool_sizes[pool]))))
        return pd.DataFrame(rows, columns=["ar_idx", "se_idx"])

    return staged.withColumn("_draw", draw(F.col(sha), F.col("pool"))).select("*", "_draw.*").drop("_draw")


def canonical_plan(drawn: DataFrame, seed: int = 0, sha: str = "raw_sha256") -> DataFrame:
    """Crop box, output size and JPEG generations of every row.

    The centre crop reaches the target aspect ratio, the short edge becomes the
    target; a JPEG arrival gets one more generation, any other two, each at a
    quality drawn for both classes alike.
    """
    w, h, ar = F.col("width"), F.col("height"), F.col("target_ar")
    too_wide = w / h > ar
    one = F.lit(1)
    crop_w = F.when(too_wide, F.greatest(one, F.bround(h * ar).cast("int"))).otherwise(w)
    crop_h = F.when(too_wide, h).otherwise(F.greatest(one, F.bround(w / ar).cast("int")))
    low, high = JPEG_QUALITY

    def quality(name):
        digest = hashing.sha(F.concat(F.lit(f"{seed}:{name}:"), F.col(sha)))
        return (low + hashing.hex_number(digest, 1, 15) % (high - low + 1)).cast("int")

    boxed = drawn.withColumn("crop_w", crop_w.cast("int")).withColumn("crop_h", crop_h.cast("int"))
    scale = F.col("target_se") / F.least("crop_w", "crop_h")
    return (boxed.withColumn("crop_x", F.floor((w - F.col("crop_w")) / 2).cast("int"))
            .withColumn("crop_y", F.floor((h - F.col("crop_h")) / 2).cast("int"))
            .withColumn("out_w", F.greatest(one, F.bround(F.col("crop_w") * scale).cast("int")))
            .withColumn("out_h", F.greatest(one, F.bround(F.col("crop_h") * scale).cast("int")))
            .withColumn("generations", F.when(F.col("arrived_jpeg"), 1).otherwise(2))
            .withColumn("quality_1", quality("q1"))
            .withColumn("quality_2", F.when(~F.col("arrived_jpeg"), quality("q2"))))
