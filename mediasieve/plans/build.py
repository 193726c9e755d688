"""Corpus build and forbidden-index build as composed jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import registry as registry_module
from ..functions import hashing
from ..operators import geometry, ingest, jobs, screen, split
from ..session import checkpointed
from ..sources import archives


def plan_build(staged: DataFrame, index: DataFrame | None, registry: dict | None = None, seed: int = 0,
               limit_per_dataset: int = 0, salt: str = split.HOLDOUT_SALT,
               allow_unscreened: bool = False) -> tuple[DataFrame, DataFrame]:
    """(accepted rows with split, targets and canonical plan, build statistics).

    ``staged`` holds hashes and sizes, no bytes: contents are joined back only by
    the canonicalize job.
    """
    kept, stats = ingest.screen(staged, index, limit_per_dataset, allow_unscreened)
    # The screened rows are read for the split, the pool and both target draws.
    kept = checkpointed(split.assign_split(kept, registry, salt=salt))
    pools = geometry.pool_targets(kept)
    return geometry.canonical_plan(geometry.draw_targets(kept, pools, seed), seed), stats


def stage_archives(spark: SparkSession, root: str, registry_rows, index: DataFrame | None, hashes,
                   limit_per_dataset: int = 0, salt: str = split.HOLDOUT_SALT,
                   allow_unscreened: bool = False) -> tuple[DataFrame, DataFrame]:
    """(accepted members with split, statistics) of all archives the registry rows name.

    ``hashes`` turns the raw rows (with ``content``) into rows with ``phash`` and ``dhash``; contents leave
    right behind it, so that mapping, screen, limit and split move keys and hashes only. Of members equal in
    content the first one, by (file, row), stays. A missing archive ends the build.
    """
    datasets = sorted({row[0] for row in registry_rows if row[6] is not None})
    raw = ingest.union_sources(*[
        hashes(archives.read_archives(spark, root, registry_rows, dataset)).drop("content") for dataset in datasets])
    mapped = ingest.map_sources(raw, spark.createDataFrame(registry_rows, registry_module.SOURCE_SCHEMA))
    staged = checkpointed(mapped.withColumn("member_id", F.concat("dataset", F.lit("/"), "file", F.lit(":"), "member")))
    kept, stats = ingest.screen(staged, index, limit_per_dataset, allow_unscreened, id_col="member_id")
    return split.assign_split(ingest.distinct_content(kept), salt=salt), stats


def run_build(staged: DataFrame, rasters: DataFrame, index: DataFrame | None, seed: int = 0,
              limit_per_dataset: int = 0, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(manifest, canonical rasters, statistics); rows are hashed and screened once.

    Staged rows feed the screen, the statistics and the geometry pool, and the row
    plan feeds both the pixel job and the manifest: both are cut from lineage.
    They hold no bytes, so what is written is small next to the rasters.
    """
    planned, stats = plan_build(checkpointed(staged), index, seed=seed,
                                limit_per_dataset=limit_per_dataset, **options)
    planned = checkpointed(planned)
    canonical = jobs.canonicalize(rasters, planned)
    rows = planned.drop("phash", "dhash").join(canonical.select("id", "sha256", "phash"), "id")
    return ingest.manifest_rows(rows, "sha256"), canonical, stats


def build_index(members: DataFrame, marker: str, expected: int, allowed_failures: int = 0,
                verify_sample: int = 50) -> DataFrame:
    """Distinct hash pairs of all marked members, refused unless complete and verified.

    ``members`` is (id, phash, dhash, ok, error) of hashed members; the marker
    names the forbidden ones, whose number must be exactly the expected one.
    """
    marked = members.where(F.col("id").cast("string").contains(marker))
    counts = marked.groupBy().agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ok")).alias("failed")).first()
    if counts["n"] != expected:
        raise ValueError(f"expected {expected} members matching {marker!r}, found {counts['n']}")
    if counts["failed"] > allowed_failures:
        raise ValueError(f"{counts['failed']} members could not be hashed and would go unscreened")
    good = marked.where("ok")
    index = checkpointed(screen.distinct_index(good))
    missed = screen.verify_index(good, index, verify_sample).where("verdict <> 'drop'").take(10)
    if missed:
        raise ValueError(f"known-forbidden members do not screen as drop: {missed}")
    return index


def index_statistics(members: DataFrame, old: DataFrame) -> DataFrame:
    """One row: hashed members, distinct pairs, and the difference to an earlier index."""
    diff = screen.index_diff(old, members)
    counted = diff.groupBy().agg(
        F.count_if(F.col("side") != "only_old").alias("pairs"),
        F.count_if(F.col("side") == "both").alias("in_both"),
        F.count_if(F.col("side") == "only_new").alias("only_new"),
        F.count_if(F.col("side") == "only_old").alias("only_old"))
    total = members.groupBy().agg(F.count(F.lit(1)).alias("members"))
    return counted.withColumn("members", total.scalar())


def export_index(index: DataFrame) -> DataFrame:
    """Hash pairs as unsigned decimal text."""
    return index.select(hashing.to_unsigned(F.col("phash")).alias("phash"), hashing.to_unsigned(F.col("dhash")).alias("dhash"))
