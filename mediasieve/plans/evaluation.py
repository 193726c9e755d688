"""The evaluation report as one tall table: (section, slice, metric, value, note)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import metrics
from ..session import checkpointed

# The named slice of low-resolution sources.
LOWRES_SLICE = ("CIFAKE/", "thumbnail_regime_cifake")
AXIS_NOTE = "AUROC against all reals of the split; the axis itself holds fakes only"
SINGLE_CLASS = "single-class slice; AUROC undefined"


def _section(frame: DataFrame, section: str, key, names, note=None) -> DataFrame:
    value = F.explode(F.array(*[
        F.struct(F.lit(name).alias("metric"), F.col(name).cast("double").alias("value")) for name in names])).alias("_m")
    slice_name = F.lit(key[1:]) if key.startswith("=") else F.col(key).cast("string")
    text = note if isinstance(note, Column) else F.lit(note).cast("string")
    return frame.select(F.lit(section).alias("section"), slice_name.alias("slice"), text.alias("note"), value).select(
        "section", "slice", "_m.metric", "_m.value", "note")


def evaluate(scored_views: DataFrame, temperature: float, threshold: float, points, replicates: int = 0,
             registry: dict | None = None) -> DataFrame:
    """Every block of the report over (id, view, label, logit, generator, source, content) rows.

    Thresholds are applied as given and never refitted. The rows are reduced once to
    a histogram per view, and the clean ones to a histogram per attribute; every
    metric reads those.
    """
    if temperature == 1.0 and threshold == 0.5:
        raise ValueError("uncalibrated scores: temperature 1 and threshold 0.5 are placeholders")
    rows = scored_views.withColumn("p", scoring.calibrated(F.col("logit"), temperature))
    per_view = checkpointed(metrics.score_histogram(rows, ["view"]))
    clean_rows = rows.where("view = 'clean'")
    clean = per_view.where("view = 'clean'")
    attributes = checkpointed(metrics.score_histogram(clean_rows, ["generator", "source", "content", "label"]))
    cells = metrics.view_metrics(per_view, threshold)
    op = metrics.operating_point_rates(per_view, points, ["view"]).withColumn(
        "slice", F.concat_ws("/", "view", "point"))
    tagged = metrics.axis_slices(attributes, registry).unionByName(metrics.named_slice(attributes, *LOWRES_SLICE))
    slices = metrics.slice_report(tagged, ["slice"], replicates=0)
    if replicates:
        # all clean rows are one more group, without a name: an image is weighed once for all groups that hold it
        every = clean_rows.withColumn("slice", F.lit(None).cast("string"))
        by_id = metrics.axis_slices(clean_rows, registry).unionByName(metrics.named_slice(clean_rows, *LOWRES_SLICE)).unionByName(every)
        intervals = checkpointed(metrics.bootstrap_ci(by_id, ["slice"], n=replicates, shared_ids=True))
        slices = slices.join(intervals, "slice", "left")
    by_content = metrics.auroc(attributes, ["content"])
    interval = ["ci_low", "ci_high"] if replicates else []
    single = F.when(F.col("auroc").isNull(), SINGLE_CLASS)
    named = F.when(F.col("auroc").isNull(), SINGLE_CLASS).when(F.col("slice") != LOWRES_SLICE[1], AXIS_NOTE)
    blocks = [
        _section(cells.where("view = 'clean'").withColumn("n", F.col("n_fake") + F.col("n_real")), "clean", "=clean",
                 ["n", "n_fake", "n_real", "auroc", "tpr", "fpr", "balanced_accuracy"]),
        _section(metrics.average_precision(clean), "clean", "=clean", ["average_precision"]),
        _section(metrics.brier(clean), "clean", "=clean", ["brier"]),
        _section(metrics.ece(clean), "clean", "=clean", ["ece"]),
        _section(cells.where("view <> 'clean'"), "cells", "view",
                 ["auroc", "auroc_drop", "mean_prob_fake", "mean_prob_real", "tpr", "fpr", "balanced_accuracy"]),
        _section(metrics.robust_summary(cells), "robustness", "worst_cell",
                 ["macro_robust_auroc", "worst_cell_auroc", "clean_to_worst"]),
        _section(op, "operating_points", "slice", ["threshold", "tpr", "fpr", "fpr_gap"]),
        _section(slices, "slices", "slice", ["n", "n_fake", "n_real", "auroc", *interval], named),
        _section(by_content, "content", "content", ["n_pos", "n_neg", "auroc"], single),
    ]
    if replicates:
        blocks.append(_section(intervals.where("slice IS NULL"), "clean", "=clean", ["ci_low", "ci_high"]))
    return reduce(DataFrame.unionByName, blocks)


def write_report(report: DataFrame, out: str) -> None:
    """The report as JSON lines in one file: it holds a few hundred rows."""
    report.orderBy("section", "slice", "metric").coalesce(1).write.mode("overwrite").json(out)
