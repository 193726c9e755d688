"""Quality by ordinal regression: hashed words share one weight each, grades have ordered thresholds."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, text_of, tidy
from .labelled import held_out, training_rows, words_of

FIT_ROWS = 8000         # labelled rows the weights are fitted on
DIMENSIONS = 1 << 17
MEMO = 150_000          # words a task remembers, about 40 MB
STEPS, RATE, RIDGE = 150, 0.15, 3e-5


def grade(quality: str = "quality", toxic: str = "toxic") -> Column:
    """Graded rating: 0 poor, 1 good but toxic, 2 good."""
    return F.when(F.col(quality) == 0, 0).when(F.col(toxic) == 1, 1).otherwise(2)


class Features:
    """Hashed words, word shapes and repetition, log counts scaled to length one."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions, self.memo = dimensions, {}

    def _hash(self, name: str) -> int:
        import xxhash

        return xxhash.xxh32_intdigest(name.encode()) % self.dimensions

    def _pair(self, word: str) -> tuple[int, int]:
        shape = re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]{2,}", "A", re.sub(r"[0-9]+", "0", re.sub(r"[^\W\d_a-zA-Z]", "a", word))))
        return self._hash("w:" + word.lower()), self._hash("s:" + shape[:12])

    def rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, feature, value) of all nonzero entries, by row."""
        bounds, codes, words = words_of(texts)
        if len(self.memo) + len(words) > MEMO:
            self.memo.clear()
        for w in words:
            if w not in self.memo:
                self.memo[w] = self._pair(w)
        table = np.array([self.memo[w] for w in words], np.int64).reshape(-1, 2)
        n = len(bounds) - 1
        of = np.repeat(np.arange(n), np.diff(bounds))
        again = np.zeros(len(codes), bool)      # the word before once more
        again[1:] = (codes[1:] == codes[:-1]) & (of[1:] == of[:-1])
        repeated = np.full(int(again.sum()), self._hash("again"))
        row = np.concatenate([of, of, of[again], np.arange(n)])
        feature = np.concatenate([table[codes, 0], table[codes, 1], repeated, np.full(n, self._hash("any"))])
        keys, counts = np.unique(row * self.dimensions + feature, return_counts=True)
        row, feature, value = keys // self.dimensions, keys % self.dimensions, np.log1p(counts)
        return row, feature, value / np.sqrt(np.bincount(row, value ** 2, n))[row]


def _featurize(batches):
    made = Features()
    for batch in batches:
        for part in slices(batch, 1):
            row, feature, value = made.rows(part.column(1))
            cut = np.searchsorted(row, np.arange(part.num_rows + 1))
            packed = [feature[a:b].astype("<i4").tobytes() + value[a:b].astype("<f4").tobytes() for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], ["grade", "features"])


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Ordinal:
    """P(grade >= j) = sigmoid(w x - threshold_j) with rising thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, row, feature, value, n) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... of each row."""
        return sigmoid(np.bincount(row, value * self.weights[feature], n)[:, None] - self.thresholds[None])

    @classmethod
    def fit(cls, row, feature, value, grades: np.ndarray, k: int = 3, dimensions: int = DIMENSIONS) -> Ordinal:
        """Maximum likelihood with a ridge, by Adam over all rows; without rows every grade is as likely."""
        n = len(grades)
        share = np.array([(np.sum(grades >= j) + k - j) / (n + k) for j in range(1, k)])
        thresholds = np.log((1 - share) / share)
        gaps = np.log(np.maximum(np.diff(thresholds), 1e-2))
        weights = np.zeros(dimensions)
        if not n:
            return cls(weights, thresholds)
        order = np.argsort(feature, kind="stable")
        used, start = np.unique(feature[order], return_index=True)
        params = np.concatenate([np.zeros(len(used)), thresholds[:1], gaps])
        place = np.searchsorted(used, feature)
        m, v, most = np.zeros_like(params), np.zeros_like(params), len(used)
        for step in range(1, STEPS + 1):
            theta = params[most] + np.concatenate([[0], np.cumsum(np.exp(params[most + 1:]))])
            eta = np.bincount(row, value * params[place], n)
            above = np.column_stack([np.ones(n), sigmoid(eta[:, None] - theta[None]), np.zeros(n)])
            low, high = above[np.arange(n), grades], above[np.arange(n), grades + 1]
            p = np.maximum(low - high, 1e-9)
            slope = lambda s: s * (1 - s)
            d_eta = -(slope(low) - slope(high)) / p / n
            d_theta = np.array([np.sum(np.where(grades == j, slope(low) / p, 0) - np.where(grades == j - 1, slope(high) / p, 0))
                                for j in range(1, k)]) / n
            g_w = np.add.reduceat((value * d_eta[row])[order], start) + RIDGE * params[:most]
            g_gap = np.array([d_theta[j + 1:].sum() for j in range(k - 2)]) * np.exp(params[most + 1:])
            g = np.concatenate([g_w, [d_theta.sum()], g_gap])
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            params -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
        weights[used] = params[:most]
        return cls(weights, params[most] + np.concatenate([[0], np.cumsum(np.exp(params[most + 1:]))]))


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Ordinal:
    """Fit on a bounded sample of labelled rows outside the held-out fold; their features come to the driver."""
    # only what the fit needs, so columns of the same name don't meet
    sample = training_rows(docs.select(id_col, text_of(text_col).alias("_text")),
                           labels.filter("quality is not null").select(id_col, grade().cast("int").alias("grade")), rows, id_col, ["grade"])
    found = sample.select(F.col("_label_grade").alias("grade"), "_text").mapInArrow(tidy(_featurize), "grade int, features binary").toArrow()
    features = [np.frombuffer(b, "<i4") for b in found["features"].to_pylist()]
    parts = [f[:len(f) // 2] for f in features]
    values = [f[len(f) // 2:].view("<f4") for f in features]
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
    return Ordinal.fit(row, join(parts, np.int64), join(values, np.float64), found["grade"].to_numpy().astype(np.int64))


def _score(model: Ordinal):
    used = np.flatnonzero(model.weights)
    feature, weight, thresholds = used.astype(np.int32), model.weights[used].astype(np.float32), model.thresholds

    def run(batches):
        weights = np.zeros(DIMENSIONS)
        weights[feature] = weight
        made, applied = Features(), Ordinal(weights, thresholds)
        for batch in batches:
            for part in slices(batch, 1, 1 << 21):
                tails = applied.tails(*made.rows(part.column(1)), part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tails.sum(axis=1)), pa.array(tails[:, 0])],
                                                 [*batch.schema.names, "_expected", "_tail"])

    return run


def _scored(docs: DataFrame, model: Ordinal, id_col: str, text_col: str, carry) -> DataFrame:
    """``_id``, ``_text``, ``_carry_*``, ``_expected``, ``_tail``."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_carry_{c}") for c in carry])
    schema = T.StructType([*rows.schema.fields, T.StructField("_expected", T.DoubleType()), T.StructField("_tail", T.DoubleType())])
    return rows.mapInArrow(tidy(_score(model)), schema)


def score(docs: DataFrame, model: Ordinal, at_least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``expected_grade``, ``tail`` (P(grade >= 1)), ``selected``.

    Selected rows have a tail of ``at_least``. Whole texts are read; null and empty
    ones get the score of a text without words. Repeated rows get equal scores and
    an empty table gives no rows.
    """
    return _scored(docs, model, id_col, text_col, ()).select(
        F.col("_id").alias(id_col), F.col("_expected").alias("expected_grade"), F.col("_tail").alias("tail"),
        (F.col("_tail") >= at_least).alias("selected"))


def select_documents(docs: DataFrame, labels: DataFrame, at_least: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
                     rows: int = FIT_ROWS) -> DataFrame:
    """The rows the model does not reject, with their columns, whatever they are called."""
    scored = _scored(docs, train(docs, labels, rows, id_col, text_col), id_col, text_col,
                     [c for c in docs.columns if c not in (id_col, text_col)])
    names = {id_col: "_id", text_col: "_text"}
    return scored.filter(F.col("_tail") >= at_least).select(*[F.col(names.get(c, f"_carry_{c}")).alias(c) for c in docs.columns])


def graded(docs: DataFrame, labels: DataFrame, at_least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit and score every row; ``held_out`` marks rows no label was learned from."""
    return score(docs, train(docs, labels, FIT_ROWS, id_col, text_col), at_least, id_col, text_col).withColumn("held_out", held_out(id_col))
