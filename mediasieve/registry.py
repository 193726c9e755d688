"""The source registry: a small resource read as flat rows.

It is held as a Python list, so its size is known before any join uses it; every
frame made here is broadcast under that bound.
"""

from __future__ import annotations

import json
from importlib import resources

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import BROADCAST_ROWS

SOURCE_SCHEMA = (
    "dataset string, kind string, pool string, axis string, holdout_split string, "
    "upstream_label int, archive string, prefix string, prefix_order int, source string, "
    "label int, generator string, architecture string, generator_licence string, "
    "content string, real_source string, held_out boolean, trained boolean"
)


def load(path: str | None = None) -> dict:
    """The registry document from a file, or the packaged one."""
    if path:
        with open(path, encoding="utf8") as handle:
            return json.load(handle)
    return json.loads(resources.files(__package__).joinpath("registry.json").read_text("utf8"))


def source_rows(registry: dict | None = None) -> list[tuple]:
    """One row per (dataset, upstream label) or (dataset, archive, prefix)."""
    rows = []
    for spec in (registry or load())["datasets"]:
        held, trained = set(spec["held_out"]), set(spec["trained"])
        for order, source in enumerate(spec["sources"]):
            parts = source.get("parts")
            archives = ([source["archive"].format(part=n) for n in range(1, parts + 1)]
                        if parts else [source.get("archive")])
            generator = source["key"] if source["label"] == 1 else ""
            for archive in archives:
                rows.append((
                    spec["dataset"], spec["kind"], spec["pool"], spec["axis"],
                    spec["holdout_split"], source.get("upstream_label"), archive,
                    source.get("prefix"), order, source["key"], source["label"], generator,
                    source.get("architecture", ""), source.get("licence", "unknown"),
                    source["content"], source.get("real_source", ""),
                    generator in held, generator in trained,
                ))
    return rows


def sources(spark: SparkSession, registry: dict | None = None) -> DataFrame:
    """The registry as a broadcast frame; refused if it outgrows the bound."""
    rows = source_rows(registry)
    if len(rows) > BROADCAST_ROWS:
        raise ValueError(f"registry has {len(rows)} rows; too large to broadcast")
    return F.broadcast(spark.createDataFrame(rows, SOURCE_SCHEMA))


def held_out_axes(registry: dict | None = None) -> dict[str, list[str]]:
    """Axis name to its held-out generators, axes without any left out."""
    axes: dict[str, list[str]] = {}
    for spec in (registry or load())["datasets"]:
        if spec["axis"] and spec["held_out"]:
            axes.setdefault(spec["axis"], []).extend(spec["held_out"])
    return {axis: sorted(set(names)) for axis, names in sorted(axes.items())}


def dataset_rules(registry: dict | None = None) -> list[dict]:
    """Per dataset: holdout split and the pinned generators."""
    return [{key: spec[key] for key in ("dataset", "holdout_split", "held_out", "trained", "pool")}
            for spec in (registry or load())["datasets"]]


def report(spark: SparkSession, registry: dict | None = None) -> DataFrame:
    """Every source with the text of its split rule, ordered by (label, source)."""
    from .functions.hashing import hex_mod, sha

    flat = sources(spark, registry)
    bucket = hex_mod(sha(F.col("generator")), 20)
    rule = (
        F.when(F.col("holdout_split") != "", F.concat(
            F.lit("upstream train->train, "), F.col("holdout_split"), F.lit("->val/test")))
        .when(F.col("label") == 0, F.lit("80/10/10 by content hash"))
        .when(F.col("held_out"), F.lit("test (whole generator)"))
        .when(F.col("trained"), F.lit("train (whole generator)"))
        .when(bucket < 16, F.lit("train (whole generator)"))
        .when(bucket < 18, F.lit("val (whole generator)"))
        .otherwise(F.lit("test (whole generator)"))
    )
    return flat.select("dataset", "label", "source", "architecture", "content",
                       rule.alias("split_rule")).distinct()
