"""Exact ranking, calibration and slice metrics over scored rows.

Rows are first reduced to one row per (group, distinct score) with a partial
aggregate, so ties and hot scores collapse before the shuffle. Ranking metrics
then read the running sums of that histogram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import registry as registry_module
from ..functions import scoring
from . import resampling
from .ordered import join_groups, pair_sums, running_sums

ECE_BINS = 15


def _names(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def _grouped(df: DataFrame, by: list[str]):
    return df.groupBy(*by) if by else df.groupBy()


def _counts(df: DataFrame, label: str) -> tuple[Column, Column]:
    """How many fakes and reals a row stands for: a scored row, or a histogram row."""
    if {"n_pos", "n_neg"} <= set(df.columns):
        return F.col("n_pos"), F.col("n_neg")
    return (F.col(label) == 1).cast("bigint"), (F.col(label) == 0).cast("bigint")


# ── histograms and ranking metrics ──────────────────────────────────────────
#
# Every metric of (score, label) takes scored rows or a histogram made from them,
# so a report over many metrics reads the rows once.

def score_histogram(df: DataFrame, by=(), score: str = "p", label: str = "label") -> DataFrame:
    """Positives and negatives per (group, distinct score); the score keeps its name."""
    pos, neg = _counts(df, label)
    return df.groupBy(*_names(by), score).agg(F.sum(pos).alias("n_pos"), F.sum(neg).alias("n_neg"))


def ranked_histogram(df: DataFrame, by=(), score: str = "p", label: str = "label",
                     neighbours: bool = False, ranges: bool = False) -> DataFrame:
    """The histogram with counts below each score, totals and neighbouring scores."""
    ranked = running_sums(score_histogram(df, by, score, label), _names(by), score, ["n_pos", "n_neg"], neighbours, ranges)
    return ranked.withColumnRenamed(score, "score")


def _auroc_of(name_pos: str, name_neg: str) -> Column:
    """AUROC from running sums, as one half plus half of Somers' D; NULL for a single class.

    D is (pairs won - pairs lost) / all pairs, so ties need no term of their own. Both
    running sums enter, so every branch of the plan reads the same columns and the
    histogram is computed once.
    """
    column = lambda name: F.col(name).cast("double")
    won = column(name_pos) * column(f"{name_neg}_below")
    lost = column(name_neg) * column(f"{name_pos}_below")
    pos, neg = F.max(f"{name_pos}_total").cast("double"), F.max(f"{name_neg}_total").cast("double")
    return F.when((pos > 0) & (neg > 0), 0.5 + F.sum(won - lost) / (2 * pos * neg))


def auroc(df: DataFrame, by=(), score: str = "p", label: str = "label", rollup: bool = False) -> DataFrame:
    """Exact AUROC per group, ties count half, NULL for a single-class group.

    With ``rollup`` a pooled row joins the groups; its group columns are NULL.
    """
    by = _names(by)
    if rollup:
        # The pooled row merges the groups' histogram instead of reading the rows again.
        cells = score_histogram(df, by, score, label)
        return auroc(cells, by, score).unionByName(auroc(cells, (), score), allowMissingColumns=True)
    ranges = pair_sums(score_histogram(df, by, score, label), by, score, "n_pos", "n_neg")
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    below = lambda name: F.coalesce(F.sum(name).over(before), F.lit(0)).cast("double")
    won = F.col("n_pos").cast("double") * below("n_neg") - F.col("n_neg").cast("double") * below("n_pos")
    pos, neg = F.sum("n_pos"), F.sum("n_neg")
    return _grouped(ranges.withColumn("_won", F.col("_pairs") + F.coalesce(won, F.lit(0.0))), by).agg(
        pos.alias("n_pos"), neg.alias("n_neg"),
        F.when((pos > 0) & (neg > 0), 0.5 + F.sum("_won") / (2 * pos.cast("double") * neg.cast("double"))).alias("auroc"))


def ranked_auroc(ranked: DataFrame, by=()) -> DataFrame:
    """AUROC per group of a ranked histogram."""
    return _grouped(ranked, _names(by)).agg(
        F.max("n_pos_total").alias("n_pos"), F.max("n_neg_total").alias("n_neg"),
        _auroc_of("n_pos", "n_neg").alias("auroc"))


def average_precision(df: DataFrame, by=(), score: str = "p", label: str = "label") -> DataFrame:
    """Step-wise average precision at distinct descending scores; NULL for a group without positives."""
    return ranked_average_precision(ranked_histogram(df, by, score, label), by)


def ranked_average_precision(ranked: DataFrame, by=()) -> DataFrame:
    """Average precision per group of a ranked histogram."""
    hits = F.col("n_pos_total") - F.col("n_pos_below")
    flagged = hits + F.col("n_neg_total") - F.col("n_neg_below")
    step = F.try_divide("n_pos", "n_pos_total") * hits / flagged
    return _grouped(ranked, _names(by)).agg(F.sum(step).alias("average_precision"))


def weighted_auroc(df: DataFrame, by, weights, score: str = "p", label: str = "label") -> DataFrame:
    """AUROC under several row weights at once: one histogram, one ordering."""
    by, weights = _names(by), list(weights)
    pos = (F.col(label) == 1)
    sums = []
    for name in weights:
        sums += [F.sum(F.when(pos, F.col(name)).otherwise(0)).alias(f"{name}_pos"),
                 F.sum(F.when(pos, 0).otherwise(F.col(name))).alias(f"{name}_neg")]
    cells = df.groupBy(*by, score).agg(*sums)
    names = [f"{name}_{side}" for name in weights for side in ("pos", "neg")]
    ranked = running_sums(cells, by, score, names)
    return _grouped(ranked, by).agg(*[_auroc_of(f"{name}_pos", f"{name}_neg").alias(name) for name in weights])


# ── bootstrap ───────────────────────────────────────────────────────────────

# Cumulative Poisson(1) probabilities of 0, 1, 2, ... events.
POISSON_ONE = (
    0.36787944117144233, 0.73575888234288467, 0.91969860292860584, 0.98101184312384626,
    0.99634015317265634, 0.99940581518241833, 0.99991675885071206, 0.99998975080332526,
    0.99999887479740204, 0.99999988857452171, 0.99999998995223373,
)


def bootstrap_weights(df: DataFrame, id_col: str, replicates: int, seed: int = 0) -> DataFrame:
    """Poisson(1) resampling weights, eight replicates per digest of (seed, block, id).

    Each row becomes ceil(replicates / 8) rows with columns ``block`` and
    ``w0..w7``; a weight depends only on the id, so all rows of one id move together.
    """
    return resampling.weight_rows(df, id_col, replicates, seed, POISSON_ONE)


def bootstrap_weight_sums(df: DataFrame, by, id_col: str, replicates: int, seed: int = 0) -> DataFrame:
    """The same weights summed by group and block, without a row per block in between."""
    return resampling.weight_sums(df, _names(by), id_col, replicates, seed, POISSON_ONE)


def replicate_auroc(df: DataFrame, by=(), score: str = "p", label: str = "label", id_col: str = "id",
                    replicates: int = 1000, seed: int = 0, shared_ids: bool = False, ids: resampling.Ids | None = None) -> DataFrame:
    """AUROC of every bootstrap replicate: (group, replicate, auroc).

    ``shared_ids`` says that few groups hold the same ids, which are then weighed once for several groups;
    ``ids`` are those of a frame that was numbered before.
    """
    return resampling.replicate_auroc(df, _names(by), score, label, id_col, replicates, seed, POISSON_ONE, shared_ids, ids=ids)


def bootstrap_ci(df: DataFrame, by=(), score: str = "p", label: str = "label", id_col: str = "id",
                 n: int = 1000, alpha: float = 0.05, seed: int = 0, shared_ids: bool = False) -> DataFrame:
    """Percentile interval of AUROC over Poisson replicates; NULL when undefined."""
    by = _names(by)
    runs = replicate_auroc(df, by, score, label, id_col, n, seed, shared_ids)
    return _grouped(runs, by).agg(
        F.percentile("auroc", alpha / 2).alias("ci_low"),
        F.percentile("auroc", 1 - alpha / 2).alias("ci_high"),
        F.count("auroc").alias("replicates"))


# ── pointwise metrics ───────────────────────────────────────────────────────

def threshold_rates(df: DataFrame, threshold, by=(), score: str = "p", label: str = "label") -> DataFrame:
    """TPR, FPR and balanced accuracy of ``score >= threshold``."""
    by, (pos, neg) = _names(by), _counts(df, label)
    flagged = F.col(score) >= (threshold if isinstance(threshold, Column) else F.lit(float(threshold)))
    rates = _grouped(df, by).agg(
        F.sum(pos + neg).alias("n"),
        (F.sum(F.when(flagged, pos).otherwise(0)) / F.sum(pos)).alias("tpr"),
        (F.sum(F.when(flagged, neg).otherwise(0)) / F.sum(neg)).alias("fpr"))
    return rates.withColumn("balanced_accuracy", (F.col("tpr") + 1 - F.col("fpr")) / 2)


def brier(df: DataFrame, by=(), score: str = "p", label: str = "label") -> DataFrame:
    pos, neg = _counts(df, label)
    squares = pos * F.pow(F.col(score) - 1, 2) + neg * F.pow(F.col(score), 2)
    return _grouped(df, _names(by)).agg((F.sum(squares) / F.sum(pos + neg)).alias("brier"))


def nll(df: DataFrame, t: float = 1.0, by=(), logit: str = "logit", label: str = "label") -> DataFrame:
    """Mean negative log-likelihood of sigmoid(logit / t)."""
    loss = scoring.softplus_loss(F.col(logit) / F.lit(float(t)), F.col(label))
    return _grouped(df, _names(by)).agg(F.avg(loss).alias("nll"))


def grid_position(value: Column, cells: int) -> Column:
    """How many points k/cells (k = 1..cells) lie at or below a value in [0, 1].

    The division is only a guess; the guess is corrected against the exact
    floating-point grid so that values on an edge fall in the upper cell.
    """
    step = F.lit(1.0) / F.lit(float(cells))
    guess = F.floor(value * cells).cast("bigint")
    point = lambda k: F.when(k >= cells, F.lit(1.0)).otherwise(k.cast("double") * step)
    return (F.when(point(guess) > value, guess - 1)
            .when((guess < cells) & (point(guess + 1) <= value), guess + 1).otherwise(guess))


def reliability(df: DataFrame, by=(), score: str = "p", label: str = "label", bins: int = ECE_BINS) -> DataFrame:
    """Count, mean score and mean label per equal-width bin; the last bin is closed."""
    pos, neg = _counts(df, label)
    binned = df.withColumn("bin", F.least(grid_position(F.col(score), bins), F.lit(bins - 1)))
    return binned.groupBy(*_names(by), "bin").agg(
        F.sum(pos + neg).alias("n"), (F.sum(F.col(score) * (pos + neg)) / F.sum(pos + neg)).alias("mean_score"),
        (F.sum(pos) / F.sum(pos + neg)).alias("mean_label"))


def ece(df: DataFrame, by=(), score: str = "p", label: str = "label", bins: int = ECE_BINS) -> DataFrame:
    """Expected calibration error from the reliability table."""
    by = _names(by)
    table = reliability(df, by, score, label, bins)
    gap = F.sum(F.col("n") * F.abs(F.col("mean_label") - F.col("mean_score"))) / F.sum("n")
    return _grouped(table, by).agg(gap.alias("ece"))


def view_consistency(views: DataFrame, clean: str = "clean", id_col: str = "id") -> DataFrame:
    """Mean drift of every view's prediction from the clean one, and loss columns."""
    # The fifteen views of an image meet in one small window: a single shuffle by id.
    of_image = Window.partitionBy(id_col)
    clean_logit = F.max(F.when(F.col("view") == clean, F.col("logit"))).over(of_image)
    label = F.col("label")
    return views.select(id_col, "view", "label", "logit", clean_logit.alias("_clean")).groupBy("view").agg(
        F.avg(scoring.bernoulli_kl(F.col("logit"), F.col("_clean"))).alias("mean_kl"),
        F.avg(scoring.focal_loss(F.col("logit"), label)).alias("focal"),
        F.avg(scoring.bce_smoothed(F.col("logit"), label)).alias("bce_smoothed"))


def feature_auroc(df: DataFrame, features, label: str = "label") -> DataFrame:
    """AUROC of each feature alone, folded to at least one half.

    Rows are unpivoted to the feature's number and its value alone, so that no names are hashed or compared.
    """
    features = list(features)
    long = df.select(label, F.posexplode(F.array(*[F.col(name).cast("double") for name in features])).alias("_feature", "value"))
    name = F.element_at(F.array(*[F.lit(name) for name in features]), F.col("_feature") + 1)
    return auroc(long, ["_feature"], "value", label).select(name.alias("feature"), F.greatest("auroc", 1 - F.col("auroc")).alias("auroc"))


# ── per-view and per-slice reports ──────────────────────────────────────────

def operating_point_rates(df: DataFrame, points, by=(), score: str = "p", label: str = "label") -> DataFrame:
    """Rates of fixed policy points applied unchanged.

    ``points`` is a list of (name, target_fpr, threshold). The rows are reduced to
    counts for all points in one pass and only then unpivoted.
    """
    by, points, (pos, neg) = _names(by), list(points), _counts(df, label)
    at = [F.col(score) >= F.lit(float(t)) for _, _, t in points]
    counts = _grouped(df, by).agg(
        F.sum(pos).alias("_pos"), F.sum(neg).alias("_neg"),
        *[F.sum(F.when(hit, pos).otherwise(0)).alias(f"_tp{i}") for i, hit in enumerate(at)],
        *[F.sum(F.when(hit, neg).otherwise(0)).alias(f"_fp{i}") for i, hit in enumerate(at)])
    rows = F.explode(F.array(*[
        F.struct(F.lit(name).alias("point"), F.lit(float(target)).alias("target_fpr"),
                 F.lit(float(t)).alias("threshold"),
                 (F.col(f"_tp{i}") / F.col("_pos")).alias("tpr"),
                 (F.col(f"_fp{i}") / F.col("_neg")).alias("fpr"),
                 (F.col("_pos") - F.col(f"_tp{i}")).alias("fn"), F.col(f"_fp{i}").alias("fp"))
        for i, (name, target, t) in enumerate(points)])).alias("_row")
    return counts.select(*by, rows).select(*by, "_row.*").withColumn("fpr_gap", F.col("fpr") - F.col("target_fpr"))


def error_counts(df: DataFrame, points, by=(), score: str = "p", label: str = "label") -> DataFrame:
    """Missed fakes, accused reals and their sum at every policy point."""
    rates = operating_point_rates(df, points, by, score, label)
    return rates.select(*_names(by), "point", "threshold", "fn", "fp", (F.col("fn") + F.col("fp")).alias("errors"))


def view_metrics(df: DataFrame, threshold: float, clean: str = "clean",
                 score: str = "p", label: str = "label") -> DataFrame:
    """Per view: AUROC, drop against clean, mean score per class and shipped-point rates."""
    cells = score_histogram(df, ["view"], score, label)
    ranks = auroc(cells, ["view"], score)
    pos, neg, flagged = F.col("n_pos"), F.col("n_neg"), F.col(score) >= F.lit(float(threshold))
    rates = cells.groupBy("view").agg(
        (F.sum(F.col(score) * pos) / F.sum(pos)).alias("mean_prob_fake"),
        (F.sum(F.col(score) * neg) / F.sum(neg)).alias("mean_prob_real"),
        (F.sum(F.when(flagged, pos).otherwise(0)) / F.sum(pos)).alias("tpr"),
        (F.sum(F.when(flagged, neg).otherwise(0)) / F.sum(neg)).alias("fpr"))
    # One row per view, fifteen in all: the window holds the report, not the rows.
    reference = F.max(F.when(F.col("view") == clean, F.col("auroc"))).over(Window.partitionBy())
    return (ranks.join(rates, "view")
            .withColumn("auroc_drop", reference - F.col("auroc"))
            .withColumn("balanced_accuracy", (F.col("tpr") + 1 - F.col("fpr")) / 2)
            .withColumnRenamed("n_pos", "n_fake").withColumnRenamed("n_neg", "n_real"))


def robust_summary(cell_auroc: DataFrame, clean: str = "clean") -> DataFrame:
    """Macro mean and worst cell over the degraded views, and the drop from clean."""
    degraded = (F.col("view") != clean) & F.col("auroc").isNotNull()
    value = F.when(degraded, F.col("auroc"))
    clean_value = F.max(F.when(F.col("view") == clean, F.col("auroc")))
    return cell_auroc.groupBy().agg(
        clean_value.alias("clean_auroc"), F.avg(value).alias("macro_robust_auroc"),
        F.min_by("view", value).alias("worst_cell"), F.min(value).alias("worst_cell_auroc"),
        (clean_value - F.min(value)).alias("clean_to_worst"))


def slice_report(df: DataFrame, by, replicates: int = 1000, score: str = "p", label: str = "label",
                 id_col: str = "id", seed: int = 0, shared_ids: bool = False) -> DataFrame:
    """One row per slice: sizes, AUROC, interval, and a note when AUROC is undefined; ``shared_ids`` as in :func:`replicate_auroc`."""
    by = _names(by)
    rows = auroc(df, by, score, label)
    if replicates:
        rows = join_groups(rows, bootstrap_ci(df, by, score, label, id_col, replicates, seed=seed, shared_ids=shared_ids), by, how="left")
    note = F.when(F.col("auroc").isNull(), F.lit("single-class slice; AUROC undefined"))
    return (rows.withColumnRenamed("n_pos", "n_fake").withColumnRenamed("n_neg", "n_real")
            .withColumn("n", F.col("n_fake") + F.col("n_real")).withColumn("note", note))


def axis_membership(df: DataFrame, registry: dict | None = None) -> DataFrame:
    """Fakes of held-out generators with the axis they belong to."""
    axes = registry_module.held_out_axes(registry)
    pairs = [(axis, name) for axis, names in axes.items() for name in names]
    small = F.broadcast(df.sparkSession.createDataFrame(pairs, "axis string, generator string"))
    return df.where("label = 1").join(small, "generator")


def axis_slices(df: DataFrame, registry: dict | None = None) -> DataFrame:
    """Per axis its held-out fakes with all reals as negatives, plus ``held_out_all``.

    Reals are repeated once per axis by exploding a constant list.
    """
    axes = list(registry_module.held_out_axes(registry))
    members = axis_membership(df, registry)
    fakes = members.withColumn("slice", F.explode(F.array("axis", F.lit("held_out_all")))).drop("axis")
    # A generator on two axes would count twice in the union slice, so the registry must not have one.
    if _generators_overlap(registry):
        raise ValueError("a held-out generator lies on two axes")
    reals = df.where("label = 0").withColumn(
        "slice", F.explode(F.array(*[F.lit(name) for name in [*axes, "held_out_all"]])))
    return fakes.unionByName(reals)


def join_attributes(scores: DataFrame, attributes: DataFrame, id_col: str = "id") -> DataFrame:
    """Scores with their attributes by id; a score without attributes fails the run."""
    marked = scores.join(attributes.withColumn("_found", F.lit(True)), id_col, "left")
    known = F.coalesce(F.col("_found"), F.raise_error(F.concat(
        F.lit("no attributes for id "), F.col(id_col).cast("string"))).cast("boolean"))
    return marked.where(known).drop("_found")


def _generators_overlap(registry: dict | None) -> bool:
    names = [name for group in registry_module.held_out_axes(registry).values() for name in group]
    return len(names) != len(set(names))


def named_slice(df: DataFrame, prefix: str, name: str) -> DataFrame:
    """Rows whose source starts with a prefix, as one named slice."""
    return df.where(F.col("source").startswith(prefix)).withColumn("slice", F.lit(name))
