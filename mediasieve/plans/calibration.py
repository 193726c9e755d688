"""A full calibration run: fit on validation rows, accept or reject, seal the record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import calibrate, views
from ..session import checkpointed

ARTIFACT_FIELDS = ("schema_version", "weights_key", "split", "tta", "temperature", "threshold", "operating_points")


def run_calibration(scored_views: DataFrame, split: str = "val", cap: int = 0, weights_key: str = "swa",
                    tta: bool = True, ece_tolerance: float = calibrate.ECE_TOLERANCE, curve_points: int = 101,
                    dry_run: bool = False, source_id: str = "") -> DataFrame:
    """The one-row calibration record with nested points and curve.

    Only the val split may be fitted. Clean and all degraded views are pooled. A cap
    bounds the rows of the temperature fit, to a class-balanced set of ids per view;
    threshold, points, curve and errors are measured on every val row.
    """
    if split != "val":
        raise ValueError(f"refusing to calibrate on split {split!r}: only val")
    if cap < 0:
        raise ValueError("cap must be >= 0; 0 keeps every row")
    rows = checkpointed(scored_views.where(F.col("split") == split).select("id", "view", "label", "logit"))
    fitted = rows
    if cap:
        ids = views.balanced_cap(rows.where("view = 'clean'").select("id", "label"), cap)
        fitted = rows.join(ids.select("id"), "id", "left_semi")
    temperature = calibrate.fit_temperature(fitted)
    scored = rows.withColumn("p", scoring.calibrated(F.col("logit"), temperature))

    record = calibrate.acceptance(rows, temperature, ece_tolerance, dry_run=dry_run)
    points = F.map_from_entries(F.array_sort(F.transform("points", lambda point: F.struct(
        F.concat(F.lit("fpr_"), point["target_fpr"].cast("string")).alias("key"), point.alias("value")))))
    plateau = F.struct("argmax_threshold", "lo", "hi", "width", "n_candidates_at_max")
    found = calibrate.operating_thresholds(scored).select(F.struct(
        "threshold", "balanced_accuracy", plateau.alias("plateau"), points.alias("points")).alias("found"))
    curve = calibrate.threshold_curve(scored, curve_points).groupBy().agg(
        F.array_sort(F.collect_list(F.struct("threshold", "tpr", "fpr", "balanced_accuracy"))).alias("curve"))
    seen = rows.groupBy().agg(F.count(F.lit(1)).alias("images"), F.array_sort(F.collect_set("view")).alias("views"))
    record = (record
              .withColumn("schema_version", F.lit(calibrate.SCHEMA_VERSION)).withColumn("weights_key", F.lit(weights_key))
              .withColumn("split", F.lit(split)).withColumn("tta", F.lit(tta)).withColumn("source_id", F.lit(source_id))
              .withColumn("_found", found.scalar())
              .withColumn("threshold", F.col("_found.threshold"))
              .withColumn("balanced_accuracy_at_threshold", F.col("_found.balanced_accuracy"))
              .withColumn("threshold_plateau", F.col("_found.plateau"))
              .withColumn("operating_points", F.col("_found.points")).withColumn("threshold_curve", curve.scalar())
              .withColumn("images", seen.select("images").scalar()).withColumn("views", seen.select("views").scalar())
              .drop("_found"))
    sealed = calibrate.artifact_id(record, [*ARTIFACT_FIELDS, "source_id"])
    return sealed.withColumn("artifact_id", F.when(F.col("status") == "accepted", F.col("artifact_id")))


def write_record(record: DataFrame, out: str, source: str = "") -> None:
    """One JSON document; never onto its own input."""
    if source and out.rstrip("/") == source.rstrip("/"):
        raise ValueError("the calibration record must not overwrite its input")
    record.coalesce(1).write.mode("overwrite").json(out)
