"""Report and prediction sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .triage import abstain


def predictions_and_errors(scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(image_path, pred) for every row and (image_path, error) for the failed ones."""
    predictions = abstain(scores).select("image_path", "pred")
    return predictions, scores.where(F.col("error").isNotNull()).select("image_path", "error")


def write_predictions(scores: DataFrame, out: str, errors_out: str) -> None:
    """Scores sorted by path (a range partition, not one task), errors apart."""
    predictions, errors = predictions_and_errors(scores)
    predictions.orderBy("image_path").write.mode("overwrite").json(out)
    errors.write.mode("overwrite").json(errors_out)


def top_errors(errors: DataFrame, k: int = 10) -> DataFrame:
    """The first k errors by path: a top-k, not a sort."""
    return errors.orderBy("image_path").limit(k)


def weakest_views(view_metrics: DataFrame, k: int = 3, clean: str = "clean") -> DataFrame:
    """The k degraded views of lowest AUROC with their drop."""
    return view_metrics.where(F.col("view") != clean).orderBy("auroc", "view").limit(k).select("view", "auroc", "auroc_drop")


def tall(metrics: DataFrame, key: str, names) -> DataFrame:
    """A wide metric table as (key, metric, value) rows."""
    return metrics.select(F.col(key).cast("string").alias("slice"), F.explode(F.array(*[
        F.struct(F.lit(name).alias("metric"), F.col(name).cast("double").alias("value")) for name in names])).alias("_m")
    ).select("slice", "_m.*")
