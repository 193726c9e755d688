"""Logistic fits by Newton steps: one pass over the rows per step, whatever the number of models.

The L2-penalised optimum is that of Spark's ``LogisticRegression``. Several models over the same rows
(feature groups, folds left out) are fitted side by side; a task reduces its rows to one gradient and one
Hessian per model, and a handful of steps suffices where first-order solvers pass over the rows a hundred times.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS = 100                 # most Newton steps, halved ones included
ENOUGH = 1e-13              # relative decrease that ends the steps


@dataclass
class Fit:
    """One model: its features, the fold it must not see, and its penalty on half the squared coefficients."""

    features: tuple[str, ...]
    penalty: float
    left_out: int | None = None


def moments(df: DataFrame, features, label: str, weight: str | None, fold: str | None) -> dict:
    """Per fold: rows, weight of all and of the positives, mean and summed squares around it of every feature; a row per fold is collected."""
    w = F.col(weight) if weight else F.lit(1.0)
    grouped = df.groupBy(fold) if fold else df.groupBy(F.lit(0).alias("fold"))
    rows = grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"), F.sum(w * F.col(label)).alias("p"),
                       *[F.avg(name).alias(f"m_{name}") for name in features], *[F.var_pop(name).alias(f"v_{name}") for name in features]).collect()
    return {row[0]: (row["n"], row["w"] or 0.0, row["p"] or 0.0, np.array([row[f"m_{name}"] for name in features], float),
                     row["n"] * np.array([row[f"v_{name}"] for name in features], float)) for row in rows if row["n"]}


def _together(folds) -> tuple:
    """Moments of several folds as one."""
    n = sum(f[0] for f in folds)
    mean = sum(f[0] * f[3] for f in folds) / n
    squares = sum(f[4] + f[0] * (f[3] - mean) ** 2 for f in folds)
    return n, sum(f[1] for f in folds), sum(f[2] for f in folds), mean, squares


def _sums(names, label, weight, fold, models, thetas, centre, scale):
    """Per task: loss, gradient and Hessian of every model at its coefficients, over its rows, flat."""
    def run(batches):
        totals = [None] * len(models)
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(float)
            x = np.column_stack([*[column(name) for name in names], np.ones(batch.num_rows)])
            y, w = column(label), column(weight) if weight else np.ones(batch.num_rows)
            if not (np.isfinite(x).all() and np.isfinite(y).all() and np.isfinite(w).all()):
                raise ValueError("a row to fit on holds a missing or non-finite number")
            x[:, :-1] = (x[:, :-1] - centre) / scale
            folds = column(fold) if fold else None
            seen = {}
            for i, (used, left_out) in enumerate(models):
                if left_out not in seen:
                    keep = slice(None) if left_out is None or folds is None else folds != left_out
                    seen[left_out] = (x[keep], y[keep], w[keep])
                rows, labels, weights = seen[left_out]
                own = np.ascontiguousarray(rows[:, used])
                margin = own @ thetas[i]
                p = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
                loss = weights @ (np.logaddexp(0, margin) - labels * margin)
                part = np.concatenate([[loss], own.T @ (weights * (p - labels)), ((own.T * (weights * p * (1 - p))) @ own).ravel()])
                totals[i] = part if totals[i] is None else totals[i] + part
        known = [i for i, total in enumerate(totals) if total is not None]
        if known:
            yield pa.RecordBatch.from_arrays([pa.array(known, pa.int32()), pa.array([totals[i] for i in known], pa.list_(pa.float64()))], ["model", "sums"])

    return run


def _added(key, table):
    total = np.sum(np.array(table["sums"].to_pylist()), axis=0)
    return pa.table({"model": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total], pa.list_(pa.float64()))})


def fit(df: DataFrame, fits: list[Fit], label: str = "label", weight: str | None = None, fold: str | None = None,
        standardise: bool = True) -> list[tuple[list[float], float]]:
    """(coefficients, intercept) of every model. ``df`` is read once for moments and once per step.

    The mean weighted loss plus ``penalty`` times half the squared coefficients is least; with ``standardise`` the
    coefficients penalised are those of features divided by their deviation (every row counting once) in the rows the model sees. A
    feature that is constant there has coefficient 0, and so has every one when those rows hold a single class.
    """
    names = sorted({name for model in fits for name in model.features})
    per_fold = moments(df, names, label, weight, fold)
    if not per_fold:
        raise ValueError("there are no rows to fit on")
    everything = _together(list(per_fold.values()))
    scale = np.sqrt(everything[4] / everything[0])
    scale[scale == 0] = 1.0
    at = {name: i for i, name in enumerate(names)}
    state = []
    for model in fits:
        folds = [own for number, own in per_fold.items() if model.left_out is None or number != model.left_out]
        if not folds:
            raise ValueError("a model sees no rows")
        n, total, positive, mean, squares = _together(folds)
        deviation = np.sqrt(squares / max(1, n - 1))
        used = [at[name] for name in model.features if deviation[at[name]] > 0]
        pen = np.array([(deviation[j] / scale[j] if standardise else 1 / scale[j]) ** 2 for j in used] + [0.0]) * model.penalty
        odds = np.log(positive / (total - positive)) if 0 < positive < total else (-np.inf if positive <= 0 else np.inf)
        theta = np.zeros(len(used) + 1)
        theta[-1] = odds
        state.append({"used": [*used, len(names)], "pen": pen, "total": total, "theta": theta, "trial": theta, "best": np.inf,
                      "length": 1.0, "done": not np.isfinite(odds)})
    for _ in range(STEPS):
        active = [i for i, s in enumerate(state) if not s["done"]]
        if not active:
            break
        work = _sums(names, label, weight, fold, [(state[i]["used"], fits[i].left_out) for i in active], [state[i]["trial"] for i in active], everything[3], scale)
        parts = df.mapInArrow(work, "model int, sums array<double>").groupBy("model").applyInArrow(_added, "model int, sums array<double>")
        for row in parts.collect():             # one row per model
            _step(state[active[row["model"]]], np.array(row["sums"]))
    out = []
    for model, s in zip(fits, state):
        found = dict(zip(s["used"][:-1], s["theta"][:-1] / scale[s["used"][:-1]]))
        weights = [float(found.get(at[name], 0.0)) for name in model.features]
        out.append((weights, float(s["theta"][-1] - sum(w * everything[3][at[name]] for w, name in zip(weights, model.features)))))
    return out


def _step(s: dict, sums: np.ndarray) -> None:
    """Take the trial if it lowers the loss, and aim at the next one; otherwise halve the step."""
    k, trial = len(s["trial"]), s["trial"]
    loss = sums[0] / s["total"] + 0.5 * (s["pen"] * trial) @ trial
    if loss > s["best"] * (1 + 1e-14):
        s["length"] /= 2
        s["done"] = s["length"] < 1e-9
    else:
        gradient = sums[1:k + 1] / s["total"] + s["pen"] * trial
        hessian = sums[k + 1:].reshape(k, k) / s["total"] + np.diag(s["pen"])
        # features that repeat each other leave the plain inverse undefined
        s["aim"] = np.linalg.lstsq(hessian, gradient, rcond=1e-13)[0]
        s["theta"], s["best"], s["length"] = trial, loss, 1.0
        if gradient @ s["aim"] <= ENOUGH * abs(loss):
            s["theta"], s["done"] = trial - s["aim"], True
            return
    s["trial"] = s["theta"] - s["length"] * s["aim"]
