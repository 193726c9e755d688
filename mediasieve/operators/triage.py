"""Triage of scored media by a fixed two-threshold policy."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Decision names, bands and reasons, strictest first.
DECISIONS = (
    ("likely_aigc", "above_1pct_fpr_threshold", "score exceeds the strict 1% FPR operating threshold"),
    ("uncertain_review", "between_5pct_and_1pct_fpr_thresholds", "score sits in the calibrated abstention band"),
    ("lower_risk", "below_5pct_fpr_threshold", "score is below the broader 5% FPR review threshold"),
)
ABSTAIN = 0.5


@dataclass(frozen=True)
class Policy:
    """Scores at or above ``action`` are acted on, at or above ``review`` looked at."""

    review: float
    action: float
    source: str = ""

    def __post_init__(self):
        if not 0.0 <= self.review <= self.action <= 1.0:
            raise ValueError("expected the 5% threshold at or below the 1% threshold, both within [0, 1]")


def read_policy(spark: SparkSession, path: str) -> Policy:
    """The policy of a calibration record: one JSON document, one row collected."""
    schema = ("operating_points struct<`fpr_0.01`: struct<threshold: double>, "
              "`fpr_0.05`: struct<threshold: double>>")
    row = spark.read.schema(schema).json(path, multiLine=True).select(
        F.col("operating_points.`fpr_0.05`.threshold").alias("review"),
        F.col("operating_points.`fpr_0.01`.threshold").alias("action")).first()
    if row is None or row["review"] is None or row["action"] is None:
        raise ValueError(f"{path} lacks the 1% and 5% operating thresholds")
    return Policy(row["review"], row["action"], path)


def classify(pred: Column, policy: Policy) -> Column:
    """Decision, band and reason of a score."""
    strict, review, low = (F.struct(*[F.lit(text).alias(name) for text, name in zip(row, ("decision", "band", "reason"))])
                           for row in DECISIONS)
    return F.when(pred >= F.lit(policy.action), strict).when(pred >= F.lit(policy.review), review).otherwise(low)


def triage(predictions: DataFrame, policy: Policy) -> tuple[DataFrame, DataFrame]:
    """(rows with their decision, count per decision with zeros)."""
    rows = predictions.withColumn("_c", classify(F.col("pred"), policy)).select(*predictions.columns, "_c.*")
    return rows, triage_summary(rows)


def triage_summary(rows: DataFrame) -> DataFrame:
    """Rows per decision in one pass; a decision that never occurs counts zero."""
    names = [name for name, _, _ in DECISIONS]
    counts = rows.groupBy().agg(*[F.count_if(F.col("decision") == name).alias(name) for name in names])
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("decision"), F.col(name).alias("n")) for name in names])).alias("_r")).select("_r.*")


def abstain(scores: DataFrame) -> DataFrame:
    """Unreadable or unscored rows keep running at one half; scores to six places."""
    return scores.withColumn("pred", F.round(F.coalesce("pred", F.lit(ABSTAIN)), 6))
