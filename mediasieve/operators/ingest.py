"""Registry mapping, screening, statistics, merging and packed-shard unpacking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing, naming
from ..session import checkpointed
from .ordered import first_rows
from .screen import near_duplicate_verdict

# The manifest columns in order.
MANIFEST_COLUMNS = (
    "path", "shard", "row_idx", "label", "source", "generator", "architecture", "generator_licence",
    "content", "real_source", "upstream_split", "split", "sha256", "phash",
)
REQUIRED_COLUMNS = ("path", "label", "split", "sha256")

_SOURCE_COLUMNS = ("source", "label", "generator", "architecture", "generator_licence", "real_source", "pool")


def union_sources(*frames: DataFrame | None) -> DataFrame:
    """All source candidates; a source that is skipped is passed as None."""
    present = [frame for frame in frames if frame is not None]
    if not present:
        raise ValueError("every source was skipped")
    out = present[0]
    for frame in present[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def map_labels(staged: DataFrame, sources: DataFrame, how: str = "inner") -> DataFrame:
    """Parquet rows: (dataset, upstream label) to a source; unmapped labels drop out."""
    by_label = sources.where(F.col("upstream_label").isNotNull()).select(
        "dataset", "upstream_label", F.col("content").alias("depicts"), *_SOURCE_COLUMNS)
    return staged.join(F.broadcast(by_label), ["dataset", "upstream_label"], how)


def _options(sources: DataFrame) -> DataFrame:
    """Registry rows as one small array per (dataset, archive); labelled datasets have archive ''."""
    return F.broadcast(sources.groupBy("dataset", F.coalesce("archive", F.lit("")).alias("archive")).agg(
        F.sort_array(F.collect_list(F.struct(
            "prefix_order", "upstream_label", "prefix", F.col("content").alias("depicts"), *_SOURCE_COLUMNS))).alias("_options")))


def map_sources(staged: DataFrame, sources: DataFrame) -> DataFrame:
    """Upstream rows of both kinds mapped to their registry source, in one pass.

    A labelled row takes the source of its label, an archive row the first declared
    prefix its member starts with. The registry rows that could apply are few and
    known, so they ride as one array and the match is an expression: no row is
    multiplied and the bytes are read once. Rows without a source drop out.
    """
    joined = staged.join(_options(sources), ["dataset", "archive"])
    labelled = F.col("archive") == ""
    matching = F.filter("_options", lambda o: F.when(
        labelled, o["upstream_label"] == F.col("upstream_label")).otherwise(F.col("member").startswith(o["prefix"])))
    skipped = F.col("member").endswith("/") | F.col("member").startswith("__MACOSX/")
    return (joined.where(labelled | ~skipped).withColumn("_match", F.get(matching, F.lit(0))).where(F.col("_match").isNotNull())
            .select(*staged.columns, "_match.depicts", *[F.col(f"_match.{c}").alias(c) for c in _SOURCE_COLUMNS]))


def match_prefixes(staged: DataFrame, sources: DataFrame) -> DataFrame:
    """Archive rows: the first declared prefix the member starts with."""
    return map_sources(staged.where(F.col("archive") != ""), sources)


def unmapped_labels(staged: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows whose upstream label or archive member no source claims, counted per dataset."""
    every = staged.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    mapped = map_sources(staged, sources).groupBy("dataset").agg(F.count(F.lit(1)).alias("m"))
    return every.join(mapped, "dataset", "left").select(
        "dataset", (F.col("n") - F.coalesce("m", F.lit(0))).alias("unmapped")).where("unmapped > 0")


def screen(staged: DataFrame, index: DataFrame | None, limit_per_dataset: int = 0,
           allow_unscreened: bool = False, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Drop forbidden paths and near-duplicates; returns (kept rows, statistics).

    ``staged`` carries phash and dhash. The path rule runs first, so it lies below
    the hash screen. The limit keeps the first accepted rows of each dataset in
    input order (file, row), counted after screening.
    """
    if index is None and not allow_unscreened:
        raise ValueError("no forbidden index given; pass allow_unscreened=True to build without one")
    seen = screened_reasons(staged, index, id_col)
    accepted = F.col("reason").isin("accepted", "review")
    if limit_per_dataset > 0:
        # Ranked rows are read twice; they hold hashes and attributes, no bytes.
        seen = first_rows(checkpointed(seen), ["dataset"], F.col("file"), [F.col("row"), F.col(id_col)],
                          limit_per_dataset, counted=accepted)
    return seen.where(accepted), build_statistics(seen)


def screened_reasons(staged: DataFrame, index: DataFrame | None, id_col: str = "doc_id") -> DataFrame:
    """Staged rows with ``reason``: forbidden_path, quarantine, review or accepted.

    Rows on forbidden paths leave before the hash screen and come back with their reason.
    """
    forbidden = F.coalesce(naming.is_forbidden_path(F.col("raw_id")), F.lit(False))
    if index is None:
        return staged.withColumn("reason", F.when(forbidden, "forbidden_path").otherwise("accepted"))
    judged = near_duplicate_verdict(staged.where(~forbidden), index, carry=True, id_col=id_col)
    judged = judged.withColumn("reason", F.when(F.col("verdict") == "drop", "quarantine")
                               .when(F.col("verdict") == "review", "review").otherwise("accepted"))
    return judged.unionByName(staged.where(forbidden).withColumn("reason", F.lit("forbidden_path")), allowMissingColumns=True)


def build_statistics(reasoned: DataFrame) -> DataFrame:
    """Counts of the build in one pass; review rows are accepted too."""
    reason = F.col("reason")
    return reasoned.groupBy().agg(
        F.count_if(reason.isin("accepted", "review")).alias("accepted"),
        F.count_if(reason == "forbidden_path").alias("dropped_forbidden_path"),
        F.count_if(reason == "quarantine").alias("dropped_quarantine"),
        F.count_if(reason == "review").alias("review_quarantine"))


def split_counts(manifest: DataFrame) -> DataFrame:
    """Rows per split, per label and together, from one cube; NULL stands for all."""
    return manifest.cube("split", "label").agg(F.count(F.lit(1)).alias("n"))


def to_manifest(canonical: DataFrame) -> DataFrame:
    """The manifest columns in order; missing optional ones are empty text."""
    missing = [name for name in REQUIRED_COLUMNS if name not in canonical.columns]
    if missing:
        raise ValueError(f"manifest is missing required columns {missing}")
    return canonical.select(*[
        (F.col("label").cast("int") if name == "label"
         else F.coalesce(F.col(name).cast("string"), F.lit("")) if name in canonical.columns
         else F.lit("")).alias(name)
        for name in MANIFEST_COLUMNS])


def merge_frames(*frames: DataFrame) -> DataFrame:
    """Manifest parts as one manifest; optional columns a part lacks become empty."""
    return to_manifest(union_sources(*frames))


def manifest_rows(staged: DataFrame, canonical_sha: str = "raw_sha256") -> DataFrame:
    """Staged rows with split and path as manifest rows plus ``raw_sha256``."""
    rows = staged.withColumn("sha256", F.col(canonical_sha)).withColumn(
        "path", naming.blob_path(F.col("dataset"), F.col("source"), F.col(canonical_sha)))
    content = F.col("depicts") if "depicts" in staged.columns else F.col("content")
    return rows.select(
        "path", F.lit("").alias("shard"), F.lit("").alias("row_idx"), "label", "source", "generator",
        "architecture", "generator_licence", content.alias("content"), "real_source", "upstream_split",
        "split", "sha256", hashing.to_unsigned(F.col("phash")).alias("phash"), "raw_sha256")


def duplicate_content(staged: DataFrame, key: str = "raw_sha256") -> DataFrame:
    """One row per content hash: the first by (dataset, file, row), content untouched."""
    first = staged.groupBy(key).agg(F.min(F.struct("dataset", "file", "row")).alias("_at"))
    return first.select(key, "_at.*")


def distinct_content(staged: DataFrame, key: str = "raw_sha256") -> DataFrame:
    """Keep one staged row per content hash."""
    return staged.join(duplicate_content(staged, key), [key, "dataset", "file", "row"], "left_semi")


# ── packed shards ───────────────────────────────────────────────────────────

def corrupt_rows(shards: DataFrame) -> DataFrame:
    """Packed rows whose bytes do not hash to the stored sha256."""
    return shards.where(hashing.sha(F.col("image")) != F.col("sha256")).drop("image")


def pending_shards(manifest: DataFrame, unpacked: DataFrame | None) -> DataFrame:
    """Shards of the manifest not yet fully unpacked: (shard, rows)."""
    wanted = manifest.where(F.col("shard") != "").groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))
    if unpacked is None:
        return wanted
    done = unpacked.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))
    return wanted.join(done, ["shard", "rows"], "left_anti")


def decode_report(hashed: DataFrame, strict: bool = False) -> DataFrame:
    """Decoded and failed rows of a hash job; strict makes the first failure fatal."""
    failed = F.count_if(~F.col("ok"))
    if strict:
        failed = F.when(failed > 0, F.raise_error(F.concat(
            F.lit("undecodable: "), F.min(F.when(~F.col("ok"), F.col("id").cast("string")))))).otherwise(failed)
    return hashed.groupBy().agg(F.count_if("ok").alias("decoded"), failed.alias("decode_errors"))
