"""Temperature, operating thresholds and the acceptance of a calibration."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing, scoring
from . import metrics

# Acceptance limits and record version.
SCHEMA_VERSION = 1
ECE_TOLERANCE = 0.01
TEMPERATURE_RANGE = (0.2, 5.0)
PLATEAU_TOLERANCE = 1e-12


def fit_temperature(df: DataFrame, logit: str = "logit", label: str = "label") -> float:
    """The temperature of least NLL, from a logistic regression through the origin.

    Equal (logit, label) rows are merged and weighted first; a slope that is not
    positive means scores are ranked backwards and the fit is refused.
    """
    cells = df.groupBy(F.col(logit).alias("logit"), F.col(label).cast("double").alias("label")).agg(
        F.count(F.lit(1)).cast("double").alias("weight"))
    data = VectorAssembler(inputCols=["logit"], outputCol="features").transform(cells)
    model = LogisticRegression(fitIntercept=False, regParam=0.0, standardization=False,
                               weightCol="weight", maxIter=200, tol=1e-12).fit(data)
    slope = float(model.coefficients[0])
    if not slope > 0:
        raise ValueError(f"temperature fit refused: slope {slope} is not positive")
    return 1.0 / slope


def ranked_scores(df: DataFrame, by=(), score: str = "p", label: str = "label") -> DataFrame:
    """The ranked histogram that :func:`thresholds_of` reads, written once."""
    return metrics.ranked_histogram(df, by, score, label, neighbours=True, ranges=True)


def _candidates(ranked: DataFrame, by) -> DataFrame:
    """Every candidate threshold with its counts at or above it.

    Candidates are 0, the midpoints of adjacent distinct scores (the score itself
    when there is only one) and 1. ``lower`` is the highest score strictly below the
    candidate, ``upper`` the lowest score at or above it.
    """
    s, after, before = F.col("score"), F.col("next_key"), F.col("previous_key")
    from_here_pos = F.col("n_pos_total") - F.col("n_pos_below")
    from_here_neg = F.col("n_neg_total") - F.col("n_neg_below")
    middle = (s + after) / 2
    # A midpoint of neighbouring doubles may round onto the lower score itself.
    on_lower = middle <= s

    def candidate(at, pos, neg, lower, upper):
        return F.struct(at.alias("t"), pos.alias("pos_ge"), neg.alias("neg_ge"),
                        lower.alias("lower"), upper.alias("upper"))

    between = F.when(after.isNotNull(), candidate(
        middle,
        F.when(on_lower, from_here_pos).otherwise(from_here_pos - F.col("n_pos")),
        F.when(on_lower, from_here_neg).otherwise(from_here_neg - F.col("n_neg")),
        F.when(on_lower, before).otherwise(s), F.when(on_lower, s).otherwise(after)))
    only = F.when(after.isNull() & before.isNull(), candidate(s, from_here_pos, from_here_neg, before, s))

    def fixed(point: float):
        """0 or 1 as a candidate, emitted by the first score at or above it ..."""
        at = F.lit(point)
        first_at_or_above = (s >= at) & (before.isNull() | (before < at))
        # ... or by the last score when every score lies below it.
        all_below = after.isNull() & (s < at)
        none = F.lit(0).cast("bigint")
        return (F.when(first_at_or_above, candidate(at, from_here_pos, from_here_neg, before, s))
                .when(all_below, candidate(at, none, none, s, F.lit(None).cast("double"))))

    return (ranked.select(*by, "_chunk", "n_pos_total", "n_neg_total",
                          F.explode(F.array_compact(F.array(fixed(0.0), between, only, fixed(1.0)))).alias("_c"))
            .select(*by, "_chunk", "n_pos_total", "n_neg_total", "_c.*")
            .withColumn("tpr", F.try_divide("pos_ge", "n_pos_total"))
            .withColumn("fpr", F.try_divide("neg_ge", "n_neg_total")))


def operating_thresholds(df: DataFrame, targets=(0.01, 0.05), by=(), score: str = "p", label: str = "label") -> DataFrame:
    """Per group the best threshold and the threshold of every FPR target, from one ordering.

    ``points`` holds (target_fpr, threshold, achieved_fpr, tpr, reached) of the targets; the
    other columns are those of :func:`best_threshold`. A group of one class has no balanced
    accuracy: its best threshold and all that belongs to it are NULL.
    """
    return thresholds_of(ranked_scores(df, by, score, label), targets, by)


def thresholds_of(ranked: DataFrame, targets=(0.01, 0.05), by=()) -> DataFrame:
    """:func:`operating_thresholds` over :func:`ranked_scores`.

    A range of the histogram reduces, where it lies, to a few rows: its lowest candidate
    per target, and for every balanced accuracy within the tolerance of its own best one
    the number, the first and the last candidate. Those rows alone meet by group.
    """
    by, targets = metrics._names(by), list(targets)
    of_range, of_group = Window.partitionBy(*by, "_chunk"), Window.partitionBy(*by)
    rows = _candidates(ranked, by).withColumn("_ba", (F.col("tpr") + (1 - F.col("fpr"))) / 2)
    near_top = F.col("_ba") >= F.max("_ba").over(of_range) - PLATEAU_TOLERANCE
    point = F.struct("t", "fpr", "tpr")
    partial = rows.withColumn("_level", F.when(near_top, F.col("_ba"))).groupBy(*by, "_chunk", "_level").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct("t", "lower")).alias("_first"), F.max(F.struct("t", "upper")).alias("_last"),
        F.max(F.when(F.col("t") == 1.0, F.struct("fpr", "tpr"))).alias("_strict"),
        *[F.min(F.when(F.col("fpr") <= F.lit(float(target)), point)).alias(f"_at{i}") for i, target in enumerate(targets)])
    best, level = F.col("_best"), F.col("_level")
    on = level >= best - PLATEAU_TOLERANCE
    merged = metrics._grouped(partial.withColumn("_best", F.max("_level").over(of_group)), by).agg(
        F.max("_best").alias("balanced_accuracy"), F.min(F.when(level == best, F.col("_first.t"))).alias("argmax_threshold"),
        F.coalesce(F.sum(F.when(on, F.col("_n"))), F.lit(0)).alias("n_candidates_at_max"),
        F.min(F.when(on, F.col("_first"))).alias("_first"), F.max(F.when(on, F.col("_last"))).alias("_last"),
        F.max("_strict").alias("_strict"), *[F.min(f"_at{i}").alias(f"_at{i}") for i in range(len(targets))])
    defined = F.col("balanced_accuracy").isNotNull()
    points = F.array(*[
        F.struct(F.lit(float(target)).alias("target_fpr"),
                 F.coalesce(F.col(f"_at{i}.t"), F.lit(1.0)).alias("threshold"),
                 F.coalesce(F.col(f"_at{i}.fpr"), F.col("_strict.fpr")).alias("achieved_fpr"),
                 F.coalesce(F.col(f"_at{i}.tpr"), F.col("_strict.tpr")).alias("tpr"),
                 F.col(f"_at{i}").isNotNull().alias("reached"))
        for i, target in enumerate(targets)])
    found = merged.select(
        *by, "balanced_accuracy", "argmax_threshold", "n_candidates_at_max",
        F.when(defined, F.coalesce(F.col("_first.lower"), F.lit(0.0))).alias("lo"),
        F.when(defined, F.coalesce(F.col("_last.upper"), F.lit(1.0))).alias("hi"), points.alias("points"))
    return (found.withColumn("width", F.col("hi") - F.col("lo"))
            .withColumn("threshold", (F.col("lo") + F.col("hi")) / 2))


def threshold_at_fpr(df: DataFrame, targets=(0.01, 0.05), by=(), score: str = "p", label: str = "label") -> DataFrame:
    """Per target the lowest candidate with FPR at or below it.

    When no candidate reaches the target the threshold is 1 and ``reached`` is false.
    """
    by = metrics._names(by)
    return operating_thresholds(df, targets, by, score, label).select(*by, F.inline("points"))


def best_threshold(df: DataFrame, by=(), score: str = "p", label: str = "label") -> DataFrame:
    """Centre of the plateau of greatest balanced accuracy, with its bounds."""
    return operating_thresholds(df, (), by, score, label).drop("points")


def threshold_curve(df: DataFrame, points: int = 101, by=(), score: str = "p", label: str = "label") -> DataFrame:
    """TPR, FPR and balanced accuracy on a fixed grid of thresholds.

    Each score falls in one grid cell, so a group comes down to at most ``points``
    cells in one pass; the grid points then sum the cells at or above them.
    """
    by, cells = metrics._names(by), points - 1
    pos, neg = metrics._counts(df, label)
    binned = df.groupBy(*by, metrics.grid_position(F.col(score), cells).alias("k")).agg(
        F.sum(pos).alias("pos"), F.sum(neg).alias("neg"))
    gathered = metrics._grouped(binned, by).agg(
        F.collect_list(F.struct("k", "pos", "neg")).alias("_cells"), F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    grid = gathered.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(cells))))

    def at_or_above(side: str):
        return F.aggregate("_cells", F.lit(0).cast("bigint"),
                           lambda total, cell: total + F.when(cell["k"] >= F.col("k"), cell[side]).otherwise(0))

    at = F.when(F.col("k") == cells, F.lit(1.0)).otherwise(F.col("k").cast("double") * (F.lit(1.0) / F.lit(float(cells))))
    return (grid.select(*by, at.alias("threshold"), (at_or_above("pos") / F.col("_pos")).alias("tpr"),
                        (at_or_above("neg") / F.col("_neg")).alias("fpr"))
            .withColumn("balanced_accuracy", (F.col("tpr") + (1 - F.col("fpr"))) / 2))


def acceptance(df: DataFrame, temperature: float, ece_tolerance: float = ECE_TOLERANCE,
               logit: str = "logit", label: str = "label", dry_run: bool = False) -> DataFrame:
    """One row: losses before and after scaling, the rule outcomes and the status."""
    t = float(temperature)
    rows = df.select(F.col(label).alias("label"), F.col(logit).alias("logit"))
    y, z = F.col("label"), F.col("logit")
    both = rows.select(
        "label", "logit",
        F.explode(F.array(F.struct(F.lit("before").alias("stage"), scoring.calibrated(z, 1.0).alias("p")),
                          F.struct(F.lit("after").alias("stage"), scoring.calibrated(z, t).alias("p")))).alias("_s")
    ).select("label", "logit", "_s.stage", "_s.p")
    scaled = F.when(F.col("stage") == "after", z / F.lit(t)).otherwise(z)
    binned = both.withColumn("bin", F.least(metrics.grid_position(F.col("p"), metrics.ECE_BINS),
                                            F.lit(metrics.ECE_BINS - 1)))
    # One pass to (stage, bin), thirty rows, then the two losses and errors per stage.
    cells = binned.groupBy("stage", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("mp"), F.avg(y.cast("double")).alias("my"),
        F.sum(scoring.softplus_loss(scaled, y)).alias("loss"), F.sum(F.pow(F.col("p") - y, 2)).alias("square"),
        F.count_if(z.isNull() | F.isnan(z) | (F.abs(z) == float("inf"))).alias("bad"))

    def of(stage, value):
        return F.sum(F.when(F.col("stage") == stage, value)) / F.sum(F.when(F.col("stage") == stage, F.col("n")))

    gap = F.col("n") * F.abs(F.col("my") - F.col("mp"))
    one = cells.groupBy().agg(
        of("before", F.col("loss")).alias("nll_before"), of("after", F.col("loss")).alias("nll_after"),
        of("before", gap).alias("ece_before"), of("after", gap).alias("ece_after"),
        of("before", F.col("square")).alias("brier_before"), of("after", F.col("square")).alias("brier_after"),
        (F.sum("bad") > 0).alias("has_bad_logits"))
    low, high = TEMPERATURE_RANGE
    rejected = (F.col("has_bad_logits") | (F.col("nll_after") > F.col("nll_before"))
                | (F.col("ece_after") > F.col("ece_before") + F.lit(float(ece_tolerance))))
    return (one.withColumn("temperature", F.lit(t))
            .withColumn("temperature_is_far", ~F.lit(t).between(low, high))
            .withColumn("status", F.when(rejected, "rejected")
                        .otherwise("dry_run" if dry_run else "accepted")))


def artifact_id(record: DataFrame, fields) -> DataFrame:
    """Add the sha256 of the named fields as JSON with sorted keys."""
    ordered = F.struct(*[F.col(name) for name in sorted(fields)])
    return record.withColumn("artifact_id", hashing.sha(F.to_json(ordered)))


def check_contract(record: DataFrame, weights: str | None = None, tta: bool = True,
                   require: bool = False) -> DataFrame:
    """Rows (rule, violations) of the score contract over a one-row record.

    With ``require`` an empty record set is itself a violation.
    """
    number = lambda name: F.col(name).cast("double")
    rules = {
        "schema_version": F.col("schema_version") != SCHEMA_VERSION,
        "status": (F.col("status") != "accepted") | F.col("artifact_id").isNull(),
        "split": F.col("split") != "val",
        "temperature": F.isnan(number("temperature")) | (number("temperature") <= 0)
        | (number("temperature") == float("inf")),
        "threshold": F.isnan(number("threshold")) | ~number("threshold").between(0.0, 1.0),
        "weights": F.col("weights_key") != F.lit(weights) if weights is not None else F.lit(False),
        "tta": F.col("tta") != F.lit(bool(tta)),
    }
    checks = record.groupBy().agg(
        *[F.count_if(F.coalesce(rule, F.lit(True))).alias(name) for name, rule in rules.items()],
        F.when(F.count(F.lit(1)) == 0, F.lit(1 if require else 0)).otherwise(0).cast("bigint").alias("record_present"))
    names = [*rules, "record_present"]
    return checks.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.col(name).alias("violations")) for name in names])).alias("_r")
    ).select("_r.*")
