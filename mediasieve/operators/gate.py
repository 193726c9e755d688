"""Branch fusion: align logit bundles, fit blends, and decide which combination ships."""

from __future__ import annotations

from functools import partial, reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing
from ..session import in_parallel, stored
from . import logistic, metrics, resampling

# Fixed value: worst-cell gain over the baseline a blend must reach.
REQUIRED_DELTA = 0.005


# ── bundles ─────────────────────────────────────────────────────────────────

BUNDLE_COLUMNS = ("id", "label", "view", "logit", "branch", "split")


def bundle_report(bundle: DataFrame) -> DataFrame:
    """One row describing a bundle: sizes, views per id, duplicates and its split stamps.

    An image's rows meet once, as its few views and stamps, combined before they are shuffled.
    """
    per_id = bundle.groupBy("id").agg(
        F.count(F.lit(1)).alias("rows"), F.size(F.collect_set("view")).cast("bigint").alias("views"),
        F.collect_set("split").alias("stamps"), F.count_if(F.col("split").isNull()).alias("unstamped"))
    return per_id.groupBy().agg(
        F.count(F.lit(1)).alias("images"), F.sum("rows").alias("rows"),
        F.min("views").alias("min_views"), F.max("views").alias("max_views"),
        F.count_if(F.col("rows") > F.col("views")).alias("duplicate_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("stamps")))).alias("splits"),
        F.sum("unstamped").alias("unstamped"))


def check_bundle(bundle: DataFrame, require_split: str | None = None) -> DataFrame:
    """The bundle itself, or an error saying why it is refused."""
    missing = [name for name in BUNDLE_COLUMNS if name not in bundle.columns]
    if missing:
        raise ValueError(f"bundle lacks columns {missing}")
    report = bundle_report(bundle).first()
    if report["min_views"] != report["max_views"]:
        raise ValueError("bundle images do not all have the same views")
    if report["duplicate_ids"]:
        raise ValueError(f"bundle repeats {report['duplicate_ids']} image ids")
    if require_split is not None:
        if report["unstamped"]:
            raise ValueError("bundle carries no split stamp")
        if report["splits"] != [require_split]:
            raise ValueError(f"bundle is split {report['splits']}, this step accepts only {require_split!r}")
    return bundle


def write_bundle(df: DataFrame, path: str, branch: str, split: str) -> None:
    """A bundle as Parquet partitioned by its branch and split stamps."""
    stamped = df.drop("branch", "split").withColumn("branch", F.lit(branch)).withColumn("split", F.lit(split))
    stamped.write.mode("append").partitionBy("branch", "split").parquet(path)


def read_bundle(spark, path: str, require_split: str | None = None, branch: str | None = None) -> DataFrame:
    """Read a bundle back; partition filters prune, then the guard runs."""
    bundle = spark.read.parquet(path)
    if branch is not None:
        bundle = bundle.where(F.col("branch") == branch)
    return check_bundle(bundle, require_split)


def alignment_report(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """One row: (id, view) pairs only in the base, only in the candidate, label conflicts."""
    a = base.select("id", "view", F.col("label").alias("_a"))
    b = candidate.select("id", "view", F.col("label").alias("_b"))
    return a.join(b, ["id", "view"], "full").groupBy().agg(
        F.count_if(F.col("_b").isNull()).alias("only_in_base"),
        F.count_if(F.col("_a").isNull()).alias("only_in_candidate"),
        F.count_if(F.col("_a") != F.col("_b")).alias("label_conflicts"))


def align(base: DataFrame, candidates: dict[str, DataFrame], check: bool = True,
          base_name: str = "A") -> DataFrame:
    """(id, view, label, one logit column per branch), refused unless every bundle agrees."""
    if check:
        reports = in_parallel(base.sparkSession, [alignment_report(base, c).first for c in candidates.values()])
        for name, report in zip(candidates, reports):
            if any(report):
                raise ValueError(f"branch {name} does not align with the baseline: {report.asDict()}")
    wide = base.select("id", "view", "label", F.col("logit").alias(base_name))
    for name, candidate in candidates.items():
        wide = wide.join(candidate.select("id", "view", F.col("logit").alias(name)), ["id", "view"])
    return wide


def _aligned(base: DataFrame, candidates: dict[str, DataFrame], base_name: str) -> DataFrame:
    """What :func:`align` returns, of bundles that hold each (id, view) once, from one shuffle, with two more columns.

    ``_fits`` says whether every branch has the row, under one label; ``_deal`` is the part of the id in which the row lies.
    """
    names = [base_name, *candidates]
    kinds = base.select("id", "view", "label").dtypes
    rows = [bundle.select(*[F.col(name).cast(kind).alias(name) for name, kind in kinds], F.col("logit").cast("double").alias("logit"), F.lit(1 << i).alias("_branch"))
            for i, bundle in enumerate((base, *candidates.values()))]
    dealt = reduce(DataFrame.unionAll, rows).withColumn("_deal", resampling.deal(F.col("id"))).repartition("_deal")
    met = dealt.groupBy("_deal", "id", "view").agg(
        F.min("label").alias("label"), *[F.max(F.when(F.col("_branch") == 1 << i, F.col("logit"))).alias(name) for i, name in enumerate(names)],
        F.max("label").alias("_most"), F.count("label").alias("_labels"), F.bit_or("_branch").alias("_branches"), F.count(F.lit(1)).alias("_rows"))
    fits = (F.col("id").isNotNull() & F.col("view").isNotNull() & (F.col("label") == F.col("_most")) & (F.col("_labels") == len(names))
            & (F.col("_rows") == len(names)) & (F.col("_branches") == (1 << len(names)) - 1))
    return met.select("id", "view", "label", *names, F.coalesce(fits, F.lit(False)).alias("_fits"), "_deal")


def half_split(df: DataFrame, id_col: str = "id", seed: int = 0) -> DataFrame:
    """Add ``half``: fit or measure, by hash of the id, the same for every row of an image."""
    digest = hashing.sha(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    return df.withColumn("half", F.when(hashing.hex_number(digest, 1, 8) % 2 == 0, "fit").otherwise("measure"))


# ── blends ──────────────────────────────────────────────────────────────────

def fit_stacker(df: DataFrame, branches) -> tuple[list[float], float]:
    """Class-balanced logistic blend over (image, view) rows: (weights, intercept)."""
    return fit_stackers(df, [list(branches)])[0]


def fit_stackers(df: DataFrame, configs: list[list[str]]) -> list[tuple[list[float], float]]:
    """A blend for every list of branches, all fitted in the same passes; a single branch stays as it is."""
    blends = [branches for branches in configs if len(branches) > 1]
    if not blends:
        return [([1.0], 0.0) for _ in configs]
    sizes = df.groupBy().agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")).first()
    if not sizes["p"] or not sizes["n"]:
        raise ValueError("the rows to fit on hold a single class")
    total = sizes["p"] + sizes["n"]
    weight = F.when(F.col("label") == 1, total / (2 * sizes["p"])).otherwise(total / (2 * sizes["n"]))
    rows = df.select(F.col("label").cast("double").alias("label"), weight.alias("weight"), *sorted({name for branches in blends for name in branches}))
    found = iter(logistic.fit(rows, [logistic.Fit(tuple(branches), 1.0 / total) for branches in blends], weight="weight", standardise=False))
    return [next(found) if len(branches) > 1 else ([1.0], 0.0) for branches in configs]


def _blend(branches, weights, bias):
    return sum((F.lit(w) * F.col(b) for w, b in zip(weights, branches)), F.lit(bias))


def subset_scores(wide: DataFrame, blends: dict[str, tuple[list[str], list[float], float]]) -> DataFrame:
    """Rows per (config, view) with the fused logit; the sigmoid keeps the order, so it is left out."""
    configs = F.explode(F.array(*[
        F.struct(F.lit(name).alias("config"), _blend(*blend).alias("fused")) for name, blend in blends.items()]))
    kept = ["id", "view", "label", *(name for name in ("_code",) if name in wide.columns)]     # _code: of resampling.number_ids
    return wide.select(*kept, configs.alias("_c")).select(*kept, "_c.*")


def worst_cells(scores: DataFrame, clean: str = "clean") -> DataFrame:
    """Per config the lowest AUROC over degraded views, and the view it falls on."""
    cells = metrics.auroc(scores, ["config", "view"], "fused")
    degraded = F.when(F.col("view") != clean, F.col("auroc"))
    return cells.groupBy("config").agg(F.min(degraded).alias("worst_cell_auroc"),
                                       F.min_by("view", degraded).alias("worst_cell"))


def rank_of(value: str, config: str = "config") -> Column:
    """Place of a config: greater value first, then fewer branches. One row per config."""
    branches = F.size(F.split(F.col(config), r"\+"))
    return F.row_number().over(Window.orderBy(F.col(value).desc(), branches, F.col(config)))


def bootstrap_delta(scores: DataFrame, rounds: int, seed: int = 0, base: str = "A", clean: str = "clean",
                    ids: resampling.Ids | None = None) -> DataFrame:
    """Per config the interval of its worst-cell gain over the base, resampling images.

    A weight depends on the image id alone, so an image's views and configs move together. ``ids`` are those of
    scores whose images were numbered before they were multiplied by config.
    """
    degraded = scores.where(F.col("view") != clean)
    runs = metrics.replicate_auroc(degraded, ["config", "view"], "fused", replicates=rounds, seed=seed, shared_ids=True, ids=ids)
    worst = runs.groupBy("config", "replicate").agg(F.min("auroc").alias("worst"))
    against = worst.where(F.col("config") == base).select("replicate", F.col("worst").alias("_base"))
    delta = F.col("worst") - F.col("_base")
    return worst.where(F.col("config") != base).join(against, "replicate").groupBy("config").agg(
        F.percentile(delta, F.lit(0.025)).alias("ci_low"), F.percentile(delta, F.lit(0.975)).alias("ci_high"),
        F.count(delta).alias("rounds"))


def _numbered_halves(base: DataFrame, candidates: dict[str, DataFrame], base_name: str, seed: int, numbered: bool) -> tuple[DataFrame, resampling.Ids | None]:
    """Aligned branches with their half, written once; on request the images to measure on are numbered on the way."""
    one_type = all(dict(bundle.dtypes)[name] == dict(base.dtypes)[name] for bundle in candidates.values() for name in ("id", "view", "label"))
    one_type = one_type and all(dict(bundle.dtypes)["logit"] == "double" for bundle in (base, *candidates.values()))
    if not one_type or not resampling.readable(base.sparkSession):
        return stored(half_split(align(base, candidates, base_name=base_name), seed=seed), "aligned"), None
    wide = half_split(_aligned(base, candidates, base_name), seed=seed)
    wide, ids = (resampling.number_ids(wide, "id", F.col("half") == "measure", dealt="_deal") if numbered else (stored(wide.drop("_deal"), "aligned"), None))
    if wide.where("NOT _fits").take(1):
        # the reports say what does not agree
        return stored(half_split(align(base, candidates, base_name=base_name), seed=seed), "aligned"), None
    return wide.drop("_fits"), ids


def run_gate(base: DataFrame, candidates: dict[str, DataFrame], required_delta: float = REQUIRED_DELTA,
             seed: int = 0, bootstrap: int = 0, base_name: str = "A") -> DataFrame:
    """Every combination of branches: fitted on one half of val, measured on the other.

    Returns one row per config with its worst cell, gain over the baseline, weights,
    whether it passes, and which config is recommended and why. The base alone is
    scored by its raw logit.
    """
    in_parallel(base.sparkSession, [partial(check_bundle, bundle, "val") for bundle in (base, *candidates.values())])
    wide, ids = _numbered_halves(base, candidates, base_name, seed, bool(bootstrap and candidates))
    fit, measure = wide.where("half = 'fit'"), wide.where("half = 'measure'")
    if not fit.take(1) or not measure.take(1):
        raise ValueError("the half split left one half empty")

    configs = [[base_name, *combo] for size in range(len(candidates) + 1) for combo in combinations(candidates, size)]
    blends = {"+".join(branches): (branches, *fitted) for branches, fitted in zip(configs, fit_stackers(fit, configs))}
    scores = subset_scores(measure, blends)
    report = worst_cells(scores).withColumnRenamed("worst_cell_auroc", "worst")
    rows = {row["config"]: row.asDict() for row in report.collect()}          # one row per config
    intervals = ({row["config"]: row.asDict() for row in bootstrap_delta(scores, bootstrap, seed, base_name, ids=ids).collect()}
                 if bootstrap and candidates else {})
    table = []
    for name, (branches, weights, bias) in blends.items():
        delta = rows[name]["worst"] - rows[base_name]["worst"]
        alone = name == base_name
        interval = intervals.get(name, {})
        table.append({
            "config": name, "n_branches": len(branches), "worst_cell": rows[name]["worst_cell"],
            "worst_cell_auroc": rows[name]["worst"], "delta": delta,
            "passes": None if alone else delta >= required_delta,
            "weights": None if alone else weights, "intercept": None if alone else bias,
            "ci_low": interval.get("ci_low"), "ci_high": interval.get("ci_high")})
    schema = ("config string, n_branches int, worst_cell string, worst_cell_auroc double, delta double, "
              "passes boolean, weights array<double>, intercept double, ci_low double, ci_high double")
    return recommend(wide.sparkSession.createDataFrame([tuple(row.values()) for row in table], schema), required_delta, base_name)


def recommend(table: DataFrame, required_delta: float, base_name: str = "A") -> DataFrame:
    """Adds ``recommended`` and ``reason`` to the gate table, one row per configuration.

    Leader: the passing blend that gains most (fewer branches win a tie). A passing
    blend of fewer branches whose interval reaches the leader's low end replaces it;
    without a passing blend the base stays.
    """
    everything = Window.partitionBy()
    claim = F.struct(F.col("delta").alias("gain"), (-F.col("n_branches")).alias("slim"), F.col("ci_low").alias("low"),
                     F.col("config").alias("name"))
    able = (F.col("n_branches") > 1) & F.coalesce("passes", F.lit(False))
    led = table.withColumn("_lead", F.max(F.when(able, claim)).over(everything))
    rival = able & (F.col("n_branches") < -F.col("_lead.slim")) & (F.col("ci_high") >= F.col("_lead.low"))
    led = led.withColumn("_rival", F.max(F.when(rival, claim)).over(everything))
    pick = F.coalesce("_rival.name", "_lead.name", F.lit(base_name))
    reason = (F.when(F.max("n_branches").over(everything) < 2, F.lit("there are no blends to compare"))
              .when(F.col("_lead").isNull(), F.lit(f"every blend gains less than {required_delta}"))
              .when(F.col("_rival").isNotNull(), F.concat(F.lit("as good as "), F.col("_lead.name"), F.lit(" within its interval, with fewer branches")))
              .otherwise(F.concat(F.lit("gains "), F.format_number("_lead.gain", 4), F.lit(" in the worst cell"))))
    return led.withColumn("recommended", F.col("config") == pick).withColumn("reason", reason).drop("_lead", "_rival")
