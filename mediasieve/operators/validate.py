"""Manifest checks as report tables, and blob checks as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing, naming
from .ingest import REQUIRED_COLUMNS
from .screen import seeded_sample

# Allowed splits and labels.
SPLITS = ("train", "val", "test")
LABELS = (0, 1)


def domain_report(manifest: DataFrame) -> DataFrame:
    """(rule, violations) of the structural rules, in one pass."""
    missing = [name for name in REQUIRED_COLUMNS if name not in manifest.columns]
    if missing:
        raise ValueError(f"manifest is missing required columns {missing}")
    forbidden = naming.is_forbidden_path(F.col("path"))
    if "raw_id" in manifest.columns:
        forbidden = forbidden | naming.is_forbidden_path(F.col("raw_id"))
    rules = {
        "split_allowed": F.count_if(~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False))),
        "label_allowed": F.count_if(F.col("label").isNotNull() & ~F.col("label").isin(*LABELS)),
        "path_not_forbidden": F.count_if(forbidden),
        "not_empty": F.when(F.count(F.lit(1)) == 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint"),
    }
    counted = manifest.groupBy().agg(*[value.alias(name) for name, value in rules.items()])
    return counted.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.col(name).alias("violations")) for name in rules])).alias("_r")).select("_r.*")


def missing_blobs(manifest: DataFrame, blobs: DataFrame) -> DataFrame:
    """Manifest rows whose blob is absent; a packed-row path is never a loose blob."""
    loose = blobs.select("path")
    return manifest.select("path", "sha256").join(loose, "path", "left_anti")


def wrong_hashes(manifest: DataFrame, blobs: DataFrame) -> DataFrame:
    """Rows whose blob bytes hash to something else. Bytes are hashed before the join."""
    digests = blobs.select("path", hashing.sha(F.col("content")).alias("actual"))
    return (manifest.where(F.col("sha256") != "").select("path", "sha256").join(digests, "path")
            .where("actual <> sha256"))


def check_sample(manifest: DataFrame, blobs: DataFrame, n: int = 256, seed: int = 0) -> DataFrame:
    """Missing and mismatched rows of a seeded sample: (path, problem)."""
    subset = manifest if n <= 0 else seeded_sample(manifest, n, seed, "path")
    digests = blobs.select("path", hashing.sha(F.col("content")).alias("actual"))
    problem = (F.when(F.col("actual").isNull(), "missing")
               .when((F.col("sha256") != "") & (F.col("actual") != F.col("sha256")), "hash mismatch"))
    return (subset.select("path", "sha256").join(digests, "path", "left")
            .select("path", problem.alias("problem")).where("problem IS NOT NULL"))
