"""Probes for shortcuts: can file statistics or frozen features tell the classes apart?"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..session import checkpointed, in_parallel, stored
from . import logistic, metrics

# Feature groups, the gate and the smallest class of a slice.
ACQUISITION = ("width", "height", "pixels", "aspect_ratio", "short_edge", "jpeg_quality",
               "n_quant_tables", "q_mean", "q_std")
CONTENT = ("file_size", "bytes_per_pixel", "dct_energy", "dct_hf_ratio", "dct_kurtosis")
GROUPS = {"ACQUISITION": ACQUISITION, "CONTENT": CONTENT, "POOLED": ACQUISITION + CONTENT}
GATE = 0.55
FOLDS = 5
SMALLEST_CLASS = 50


def content_held_constant(df: DataFrame) -> DataFrame:
    """Fakes prompted from COCO against COCO reals, so that content is the same."""
    has_coco = lambda name: F.lower(F.coalesce(F.col(name), F.lit(""))).contains("coco")
    return df.where(((F.col("label") == 1) & has_coco("real_source")) | ((F.col("label") == 0) & has_coco("source")))


def slice_is_usable(df: DataFrame, smallest: int = SMALLEST_CLASS) -> DataFrame:
    """(n_fake, n_real, usable) of a slice."""
    sizes = df.groupBy().agg(F.count_if(F.col("label") == 1).alias("n_fake"), F.count_if(F.col("label") == 0).alias("n_real"))
    return sizes.withColumn("usable", F.least("n_fake", "n_real") >= smallest)


def with_folds(df: DataFrame, folds: int = FOLDS, id_col: str = "id", seed: int = 0) -> DataFrame:
    """Fold by hash of the id: each class falls evenly in every fold."""
    digest = hashing.sha(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    return df.withColumn("fold", (hashing.hex_number(digest, 1, 8) % folds).cast("int"))


def out_of_fold(df: DataFrame, features, folds: int = FOLDS, reg_c: float = 1.0) -> DataFrame:
    """(label, p) where each row is scored by a model that did not see its fold.

    The folds are fitted side by side; features are standardised by the training folds alone.
    """
    return _scored_out_of_fold(df, {"all": tuple(features)}, folds, reg_c).drop("block")


def _scored_out_of_fold(df: DataFrame, groups: dict, folds: int = FOLDS, reg_c: float = 1.0) -> DataFrame:
    """(label, block, p) for every group of features; the models of all groups and folds share their passes."""
    sizes = {row["fold"]: row["n"] for row in df.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    asked = [(block, fold) for block in groups for fold in range(folds) if sizes.get(fold, 0)]
    fits = logistic.fit(df, [logistic.Fit(tuple(groups[block]), 1.0 / (reg_c * (total - sizes[fold])), fold) for block, fold in asked], fold="fold")
    found = dict(zip(asked, fits))

    def p(block: str):
        margins = []
        for fold in sorted(sizes):
            weights, bias = found[block, fold]
            margins.append(F.when(F.col("fold") == fold, sum((F.lit(w) * F.col(name) for w, name in zip(weights, groups[block])), F.lit(bias))))
        return 1 / (1 + F.exp(-F.coalesce(*margins)))

    each = F.explode(F.array(*[F.struct(F.lit(block).alias("block"), p(block).alias("p")) for block in groups])).alias("_s")
    return df.select("label", each).select("label", "_s.block", "_s.p")


def shortcut_probe(df: DataFrame, id_col: str = "id", gate: float = GATE, groups=None) -> DataFrame:
    """Per feature group its out-of-fold AUROC and whether it stays at or below the gate."""
    groups = groups or GROUPS
    names = sorted({name for group in groups.values() for name in group})
    # read once per Newton step: columns, not rows
    data = stored(with_folds(df, id_col=id_col).select("fold", F.col("label").cast("double").alias("label"), *[F.col(n).cast("double").alias(n) for n in names]), "probe")
    return metrics.auroc(_scored_out_of_fold(data, groups), ["block"]).select(
        "block", "auroc", F.lit(gate).alias("gate"), (F.col("auroc") <= gate).alias("passes"))


def probe_verdict(report: DataFrame, gate_on: str = "pooled") -> DataFrame:
    """One row: both verdicts and the exit code, 0 when the chosen gate lets the data through."""
    passed = lambda block: F.max(F.when(F.col("block") == block, F.col("passes")))
    verdict = report.groupBy().agg(passed("POOLED").alias("pooled_ok"), passed("ACQUISITION").alias("acquisition_ok"))
    lenient = F.lit(gate_on == "acquisition")
    return verdict.withColumn("exit_code", F.when(~F.col("acquisition_ok"), 1).when(F.col("pooled_ok") | lenient, 0).otherwise(1))


def linear_probe(df: DataFrame, features: str = "embedding", label: str = "label", folds: int = 0, id_col: str = "id") -> DataFrame:
    """A linear head on L2-normalised frozen features: rows with logit and p.

    With ``folds`` each row is scored by a head that did not see its fold; without, by one
    head fitted on all rows, whose scores of those same rows flatter it.
    """
    kept = [name for name in df.columns if name not in (features, label)]
    rows = df.select(*kept, F.col(label).cast("double").alias("label"), array_to_vector(F.col(features).cast("array<double>")).alias("raw"))

    def scored(seen: DataFrame, asked: DataFrame) -> DataFrame:
        fit = Pipeline(stages=[
            Normalizer(inputCol="raw", outputCol="features", p=2.0),
            LogisticRegression(labelCol="label", regParam=1e-4, maxIter=100)]).fit(seen)
        return fit.transform(asked).select(
            *kept, F.col("label").cast("int").alias("label"),
            vector_to_array("rawPrediction")[1].alias("logit"), vector_to_array("probability")[1].alias("p"))

    if not folds:
        return scored(rows, rows)
    data = checkpointed(with_folds(rows, folds, id_col))
    parts = in_parallel(df.sparkSession, [
        partial(lambda fold: scored(data.where(F.col("fold") != fold), data.where(F.col("fold") == fold)), fold) for fold in range(folds)])
    return reduce(DataFrame.unionByName, parts)
