"""Leakage-safe split assignment and its checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import registry as registry_module
from ..functions import hashing

# Halves an upstream holdout in val and test. To continue an existing build,
# pass the salt that build used: the salt alone decides the halves.
HOLDOUT_SALT = "holdout-halves/v1"


def assign_split(df: DataFrame, registry: dict | None = None, sha: str = "raw_sha256",
                 salt: str = HOLDOUT_SALT) -> DataFrame:
    """Add ``split`` from (dataset, upstream_split, label, generator, content hash).

    Per-dataset rules are a few constants from the registry, so the whole
    assignment is one CASE expression: no join and no shuffle.
    """
    digest, label, generator, dataset = F.col(sha), F.col("label"), F.col("generator"), F.col("dataset")
    rules = registry_module.dataset_rules(registry)
    halved = [rule["dataset"] for rule in rules if rule["holdout_split"]]
    # The hash draws are columns of their own, so that the CASE below stays small.
    drawn = df.withColumns({
        "_content": hashing.hex_mod(digest, 20),
        "_generator": F.when(label == 1, hashing.hex_mod(hashing.sha(generator), 20)),
        "_half": F.when(dataset.isin(halved), hashing.hex_mod(hashing.sha(F.concat(F.lit(salt), digest)), 2))})
    content, tenth = F.col("_content"), F.col("_content") % 10

    assigned = None
    for rule in rules:
        if rule["holdout_split"]:
            value = (F.when(F.col("upstream_split") == "train", "train")
                     .when(F.col("upstream_split") == rule["holdout_split"],
                           F.when(F.col("_half") == 0, "val").otherwise("test"))
                     .otherwise(F.raise_error(F.concat(
                         F.lit(f"{rule['dataset']}: unknown upstream split "),
                         F.coalesce("upstream_split", F.lit("NULL"))))))
        else:
            whole = F.col("_generator")
            value = (F.when((label == 1) & generator.isin(rule["held_out"]), "test")
                     .when((label == 1) & generator.isin(rule["trained"]),
                           F.when(content < 18, "train").otherwise("val"))
                     .when(label == 1, F.when(whole < 16, "train").when(whole < 18, "val").otherwise("test"))
                     .otherwise(F.when(tenth < 8, "train").when(tenth < 9, "val").otherwise("test")))
        hit = dataset == rule["dataset"]
        assigned = F.when(hit, value) if assigned is None else assigned.when(hit, value)
    return drawn.withColumn("split", assigned.otherwise(
        F.raise_error(F.concat(F.lit("unknown dataset "), dataset)))).drop("_content", "_generator", "_half")


def leakage(manifest: DataFrame, key: str = "raw_sha256") -> DataFrame:
    """Content hashes that occur in more than one split, with their copies."""
    flags = [F.max((F.col("split") == name).cast("int")).alias(name) for name in ("train", "val", "test")]
    counted = manifest.groupBy(key).agg(F.count(F.lit(1)).alias("copies"), *flags)
    splits = F.col("train") + F.col("val") + F.col("test")
    return counted.withColumn("splits", splits).where("splits > 1").select(key, "copies", "splits")


def misplaced_held_out(manifest: DataFrame, registry: dict | None = None) -> DataFrame:
    """Rows of held-out generators that are not in test."""
    names = [name for group in registry_module.held_out_axes(registry).values() for name in group]
    return manifest.where(F.col("generator").isin(names) & (F.col("split") != "test"))


def unpinned_generators(rows: DataFrame, registry: dict | None = None) -> DataFrame:
    """Generators of fakes that no list pins, so that a hash decides their split, with row counts."""
    rules = registry_module.dataset_rules(registry)
    pinned = [name for rule in rules for name in rule["held_out"] + rule["trained"]]
    return (rows.where((F.col("label") == 1) & ~F.col("generator").isin(pinned))
            .groupBy("generator").agg(F.count(F.lit(1)).alias("n")))


def pinned_overlap(spark, registry: dict | None = None) -> DataFrame:
    """Generators that are both held out and trained; must be empty."""
    rows = registry_module.sources(spark, registry)
    held, trained = rows.where("held_out").select("generator"), rows.where("trained").select("generator")
    return held.intersect(trained)
