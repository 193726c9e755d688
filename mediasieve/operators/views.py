"""Degradation views and class-balanced row caps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from .ordered import first_rows

# The evaluation grid, one degradation at one severity per cell.
GRID = (
    "jpeg_q90", "jpeg_q70", "jpeg_q50", "jpeg_q30",
    "blur_s0.5", "blur_s1.0", "blur_s2.0",
    "resize_0.50x", "resize_0.25x",
    "noise_s0.02", "noise_s0.05", "noise_s0.10",
    "jitter_20pct", "crop_80pct",
)
VIEWS = ("clean", *GRID)

# Training tiers as (name, share, fewest, most transforms).
TIERS = (("L1", 0.10, 0, 0), ("L2", 0.35, 1, 1), ("L3", 0.40, 2, 3), ("L4", 0.15, 4, 5))


def fan_out(df: DataFrame, views=VIEWS) -> DataFrame:
    """Every row once per view; a narrow explode of a constant, no join."""
    names = F.array(*[F.lit(name) for name in views])
    return df.select("*", F.posexplode(names).alias("view_no", "view"))


def view_seed(view="view"):
    """Seed of a view's noise, the first 8 bytes of the sha256 of its name."""
    return hashing.seed64(F.col(view))


def balanced_cap(df: DataFrame, cap: int, label: str = "label", id_col: str = "id", seed: int = 0) -> DataFrame:
    """At most ``cap // 2`` rows per label in hash order; everything if it already fits."""
    if cap <= 0:
        return df
    digest = hashing.sha(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    keyed = df.withColumn("_digest", digest)
    kept = first_rows(keyed, [label], F.substring("_digest", 1, 3), [F.col("_digest"), F.col(id_col)],
                      max(1, cap // 2), keep_all_up_to=cap)
    return kept.drop("_digest")


def tier_plan(df: DataFrame, id_col: str = "id", seed: int = 0, epoch: int = 0) -> DataFrame:
    """Draw a training tier and its number of transforms from hashed uniforms."""
    key = F.concat(F.lit(f"{seed}:{epoch}:"), F.col(id_col).cast("string"))
    draw, count = hashing.uniform(F.concat(key, F.lit(":tier"))), hashing.uniform(F.concat(key, F.lit(":k")))
    tier, fewest, most, cumulative = None, None, None, 0.0
    for name, share, low, high in TIERS[:-1]:
        cumulative += share
        inside = F.col("_draw") <= F.lit(cumulative)
        tier = F.when(inside, name) if tier is None else tier.when(inside, name)
        fewest = F.when(inside, low) if fewest is None else fewest.when(inside, low)
        most = F.when(inside, high) if most is None else most.when(inside, high)
    name, _, low, high = TIERS[-1]
    drawn = df.withColumn("_draw", draw)
    span = most.otherwise(high) - fewest.otherwise(low) + 1
    return drawn.select(*df.columns, tier.otherwise(name).alias("tier"),
                        (fewest.otherwise(low) + F.floor(count * span)).cast("int").alias("transforms"))
