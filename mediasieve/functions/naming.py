"""Path and name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path fragments that mark forbidden validation content.
FORBIDDEN_PATH_TOKENS = (
    "coco2017/val2017/",
    "/DALLE/Advanced/",
    "/Advanced/DALLE3/",
    "DALLE/Advanced/",
)

# Fixed value: the logical key of a row inside a packed shard.
SHARD_KEY = r"^((?:[^#/]+/)*full/[^#/]+\.parquet)#(\d+)$"


def is_forbidden_path(path, tokens=FORBIDDEN_PATH_TOKENS) -> Column:
    """True when the path, with forward slashes, holds any of the tokens."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    hit = F.lit(False)
    for token in tokens:
        hit = hit | slashed.contains(token)
    return hit


def safe_part(text) -> Column:
    """One path-safe token; ``unknown`` when nothing is left."""
    token = F.btrim(F.regexp_replace(text, r"[^A-Za-z0-9_.-]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(token, F.lit("")), F.lit("unknown"))


def upstream_split(file_name) -> Column:
    """The part of a shard file name before the first dash, without suffix."""
    return F.split_part(F.regexp_replace(file_name, r"\.parquet$", ""), F.lit("-"), F.lit(1))


def shard_of(path) -> Column:
    """Shard file of a packed-row key, NULL for a loose file."""
    return F.nullif(F.regexp_extract(path, SHARD_KEY, 1), F.lit(""))


def shard_row(path) -> Column:
    """Row index of a packed-row key, NULL for a loose file."""
    return F.nullif(F.regexp_extract(path, SHARD_KEY, 2), F.lit("")).cast("bigint")


def spelled_path(path, root: str, style: str = "relative") -> Column:
    """How an image is named in the output: relative, basename or absolute."""
    if style == "absolute":
        return path
    if style == "basename":
        return F.element_at(F.split(path, "/"), -1)
    if style == "relative":
        return F.substring(path, F.lit(len(root.rstrip("/")) + 2), F.length(path))
    raise ValueError(f"unknown path style {style!r}")


def blob_path(dataset, source, digest) -> Column:
    """Content-addressed location of a canonical image."""
    return F.concat_ws("/", dataset, safe_part(source), F.substring(digest, 1, 2),
                       F.concat(digest, F.lit(".jpg")))
