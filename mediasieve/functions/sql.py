"""Expressions as SQL functions and metrics as views, for users who write SQL.

The functions are SQL functions, so Spark inlines them and they stay inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed
from .hashing import band_ranges

FUNCTIONS = {
    "hamming_distance": "(a BIGINT, b BIGINT) RETURNS INT RETURN bit_count(a ^ b)",
    "calibrated_score": "(logit DOUBLE, temperature DOUBLE) RETURNS DOUBLE "
                        "RETURN 1D / (1D + exp(-logit / greatest(temperature, 1e-6D)))",
    "path_token": "(name STRING) RETURNS STRING RETURN coalesce(nullif("
                  "trim(BOTH '_' FROM regexp_replace(name, '[^A-Za-z0-9_.-]+', '_')), ''), 'unknown')",
    "unsigned_hash": "(h BIGINT) RETURNS STRING RETURN conv(hex(h), 16, 10)",
}


def register(spark: SparkSession, bands: int = 6) -> None:
    """Create the temporary functions, and ``band_key_rows(h)`` as a table function."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    rows = ", ".join(f"struct({i} AS band, shiftrightunsigned(h, {low}) & {(1 << (high - low)) - 1}L AS value)"
                     for i, (low, high) in enumerate(band_ranges(bands)))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION band_key_rows(h BIGINT) RETURNS TABLE (band INT, value BIGINT) "
              f"RETURN SELECT k.band, k.value FROM (SELECT explode(array({rows})) AS k)")


def publish_metrics(spark: SparkSession, table: str, by=(), score: str = "p", label: str = "label",
                    targets=(0.01, 0.05)) -> list[str]:
    """Views over a scored table or view, one row per group of ``by``; their names.

    ``<table>_auroc``, ``<table>_average_precision``, ``<table>_ece``, ``<table>_best_threshold``
    and ``<table>_thresholds`` (a row per group and FPR target). The rows are ranked once, at this
    call, from one histogram that the error of calibration reads too: the views hold the table as it was then.
    A dotted table name gives views named by its last part. Calling again replaces them.
    """
    from ..operators import calibrate, metrics

    by = metrics._names(by)
    rows = spark.table(table)
    cells = checkpointed(metrics.score_histogram(rows, by, score, label))
    ranked = calibrate.ranked_scores(cells, by, score)
    operating = calibrate.thresholds_of(ranked, targets, by)
    views = {"auroc": metrics.ranked_auroc(ranked, by), "average_precision": metrics.ranked_average_precision(ranked, by),
             "ece": metrics.ece(cells, by, score), "best_threshold": operating.drop("points"),
             "thresholds": operating.select(*by, F.inline("points"))}
    stem = table.split(".")[-1].strip("`")
    for name, frame in views.items():
        frame.createOrReplaceTempView(f"{stem}_{name}")
    return [f"{stem}_{name}" for name in views]
