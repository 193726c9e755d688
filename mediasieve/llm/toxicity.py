"""Toxicity: Levenshtein automata met with a lexicon trie, weighed by the words around each hit."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, slices, text_of
from .labelled import held_out, training_rows, words_of
from .quality import sigmoid

FIT_ROWS = 40_000           # labelled rows that lexicon and weights are learned from
EVIDENCE = 15.0             # n x divergence from the base rate that an entry needs
PRECISE = 0.8               # share of toxic documents among those with the entry
STEM = (4, 8)               # lengths of word beginnings that may become entries
WINDOW = 8                  # words before and after a hit that are its context
REPORTING = frozenset("said says say wrote writes quoted quotes quote called calls word words term reported reports according dit "
                      "écrit selon sagte schrieb laut dijo escribió según".split())
QUOTES = "\"“”„«»‘’'"
EDGE = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
FEATURES = 9


def edits_of(term: str) -> int:
    """Misspellings allowed: none below five letters, one, and two from nine on."""
    return (len(term) >= 5) + (len(term) >= 9)


class Walk:
    """A trie of terms met with all their Levenshtein automata, which are careful in the first half of a term.

    Of a misspelling with e edits one half of the term holds at most e // 2. A walk allows
    only those before the middle and all of them after it; the walk over reversed terms
    finds the others. So a state, a set of (node, edits so far), stays small. States and
    steps are made when a word first needs them and then remembered.
    """

    def __init__(self, terms: list[tuple[str, int, int]]):
        self.children: list[dict[str, int]] = [{}]
        self.most, self.word = [0], [-1]
        for term, edits, middle in terms:
            at = 0
            self.most[0] = max(self.most[0], edits // 2)
            for depth, c in enumerate(term, 1):
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.most.append(0)
                    self.word.append(-1)
                at = self.children[at][c]
                self.most[at] = max(self.most[at], edits // 2 if depth < middle else edits)
            self.word[at] = edits
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.start = self._number(self._closed([(0, 0)]))

    def _number(self, state: frozenset) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
        return self.numbers[state]

    def _closed(self, todo: list) -> frozenset:
        """With letters of a term left out."""
        best: dict[int, int] = {}
        while todo:
            node, e = todo.pop()
            if e > self.most[node] or best.get(node, 9) <= e:
                continue
            best[node] = e
            todo += [(child, e + 1) for child in self.children[node].values() if e < self.most[child]]
        return frozenset(best.items())

    def _step(self, number: int, c: str) -> int:
        new, most = [], self.most
        for node, e in self.states[number]:
            if e < most[node]:
                new.append((node, e + 1))
            for letter, child in self.children[node].items():
                if letter == c:
                    new.append((child, e))
                elif e < most[child]:
                    new.append((child, e + 1))
        self.steps[number][c] = at = self._number(self._closed(new))
        return at

    def accepts(self, word: str) -> bool:
        """Within the edits of a term, not too many of them in its first half."""
        if len(self.states) > 50_000:
            self._forget()
        at = self.start
        for c in word:
            step = self.steps[at].get(c)
            at = self._step(at, c) if step is None else step
            if not self.states[at]:
                return False
        return any(self.word[node] >= e for node, e in self.states[at])


class FuzzyTrie:
    """Lexicon of words and word beginnings: a trie for the entries themselves, two walks for misspellings."""

    def __init__(self, words: list[str], stems: list[str], known: frozenset = frozenset()):
        self.children: list[dict[str, int]] = [{}]
        self.word, self.stem, self.known = [False], [False], known
        for term, is_stem in [(w, False) for w in words] + [(s, True) for s in stems]:
            at = 0
            for c in term:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.word.append(False)
                    self.stem.append(False)
                at = self.children[at][c]
            (self.stem if is_stem else self.word)[at] = True
        inexact = [(w, edits_of(w), len(w) // 2) for w in words if edits_of(w)]
        self.forth = Walk(inexact)
        self.back = Walk([(w[::-1], edits, len(w) - middle) for w, edits, middle in inexact])

    def holds(self, word: str) -> bool:
        """An entry itself, or a word that begins with a stem."""
        at = 0
        for c in word:
            at = self.children[at].get(c, -1)
            if at < 0:
                return False
            if self.stem[at]:
                return True
        return self.word[at]

    def match(self, word: str) -> int:
        """0 no hit, 1 an entry itself (or a word that begins with a stem), 2 a misspelling."""
        if self.holds(word):
            return 1
        if word in self.known:      # a word of its own in clean texts
            return 0
        return 2 if self.forth.accepts(word) or self.back.accepts(word[::-1]) else 0


def bare(word: str) -> str:
    """Without marks around it."""
    return re.sub(r"^[\W_]+|[\W_]+$", "", word)


def word_table(sample: DataFrame) -> DataFrame:
    """``word, n1, n0``: toxic and other training documents that hold each word."""
    words = sample.select("_label_toxic", F.explode(F.array_distinct(F.split(F.lower("_text"), SPACES))).alias("_word"))
    return (words.select("_label_toxic", F.regexp_replace("_word", EDGE, "").alias("word")).filter("word != ''")
            .groupBy("word").agg(F.sum("_label_toxic").cast("long").alias("n1"), F.sum(1 - F.col("_label_toxic")).cast("long").alias("n0")))


def evidence(n1, n0, rate: float):
    """n times the divergence of the entry's toxic share from the base rate."""
    n, share = n1 + n0, n1 / (n1 + n0)
    clean = F.when(n0 > 0, n0 * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    return F.when(share > rate, n1 * F.log(share / rate) + clean).otherwise(0.0)


def learn_lexicon(table: DataFrame, rate: float) -> FuzzyTrie:
    """Entries that toxic documents hold far more often: words, and beginnings that several words share.

    All entries above the bounds are kept, in the automata and among known clean
    words; all come from the ``FIT_ROWS`` labelled texts at most, which bounds them.
    """
    strong = (evidence(F.col("n1"), F.col("n0"), rate) >= EVIDENCE) & (F.col("n1") >= PRECISE * (F.col("n1") + F.col("n0")))
    stems = (table.filter("n1 > 0 or n0 > 0").select("word", "n1", "n0", F.explode(F.sequence(F.lit(STEM[0]), F.lit(STEM[1]))).alias("size"))
             .filter(F.length("word") >= F.col("size")).groupBy(F.substring("word", 1, F.col("size")).alias("stem"))
             .agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.max("n1").alias("most"), F.sum((F.col("n1") > 0).cast("int")).alias("words"))
             .filter(strong & (F.col("words") >= 3) & (F.col("most") <= 0.8 * F.col("n1"))))
    found = [r[0] for r in stems.orderBy(F.col("n1").desc(), "stem").select("stem").collect()]
    stem_set = set(found)
    found = [s for s in found if not any(s[:k] in stem_set for k in range(STEM[0], len(s)))]
    words = [r[0] for r in table.filter(strong).orderBy(F.col("n1").desc(), "word").select("word").collect()]
    # words that begin with a stem stay: stems match only exactly, misspellings are met by words
    trie = FuzzyTrie(words, found)

    def near(batches):
        for batch in batches:
            hit = [trie.match(w) == 2 for w in batch.column(0).to_pylist()]
            yield batch.filter(pa.array(hit, pa.bool_()))

    # misspellings that clean documents hold too are words of their own; few words are that near an entry
    alike = table.filter(F.col("n0") > F.col("n1")).select("word").mapInArrow(near, "word string")
    known = frozenset(r[0] for r in alike.orderBy("word").collect())
    return FuzzyTrie(words, found, known)


def contexts(words: list[str], hits: list[tuple[int, int]]) -> list[float]:
    """Features of one text from its words and (place, kind) of its hits."""
    direct, fuzzy, told, crowded = 0, 0, 0, 0
    for place, kind in hits:
        before = [bare(w) for w in words[max(0, place - WINDOW):place]]
        quoted = _quoted(words, place)
        if quoted and (quoted == 2 or any(w in REPORTING for w in before)) or any(w in REPORTING for w in before[-3:]):
            told += 1
        elif kind == 1:
            direct += 1
        else:
            fuzzy += 1
    places = [p for p, _ in hits]
    crowded = sum(b - a <= WINDOW for a, b in zip(places[:-1], places[1:]))
    share = (direct + fuzzy) / max(1, len(words))
    return [float(direct > 0), np.log1p(direct), float(fuzzy > 0), np.log1p(fuzzy), float(told > 0), np.log1p(told), np.log1p(crowded),
            min(1.0, 20 * share)]


def _quoted(words: list[str], place: int) -> int:
    """0 outside quotation marks, 1 the word alone in them, 2 within a quoted run of words."""
    word = words[place]
    if word[0] in QUOTES and word.rstrip(".,;:!?")[-1] in QUOTES:
        return 1
    opened = any(w[0] in QUOTES and w.rstrip(".,;:!?")[-1] not in QUOTES for w in words[max(0, place - WINDOW):place + 1])
    closed = any(w.rstrip(".,;:!?")[-1:] and w.rstrip(".,;:!?")[-1] in QUOTES for w in words[place:place + WINDOW + 1])
    return 2 if opened and closed else 0


class Scorer:
    """Features of texts: none but the constant without hits."""

    def __init__(self, trie: FuzzyTrie):
        self.trie, self.memo = trie, {}

    def kind(self, word: str) -> int:
        core = bare(word)
        if not core:
            return 0
        whole = self.trie.match(core)
        if not whole and not core.isalnum():
            whole = int(any(self.trie.holds(piece) for piece in re.split(r"[\W_]+", core)))
        return whole

    def features(self, texts: pa.Array) -> np.ndarray:
        bounds, codes, words = words_of(pc.utf8_lower(pc.fill_null(texts, "")))
        if len(self.memo) + len(words) > 500_000:
            self.memo.clear()
        for w in words:
            if w not in self.memo:
                self.memo[w] = self.kind(w)
        kinds = np.array([self.memo[w] for w in words], np.int8)[codes] if len(codes) else np.zeros(0, np.int8)
        out = np.zeros((len(bounds) - 1, FEATURES))
        out[:, 0] = 1
        places = np.flatnonzero(kinds)
        texts_of = np.searchsorted(bounds, places, side="right") - 1
        for k in np.unique(texts_of):
            a, b = bounds[k], bounds[k + 1]
            mine = places[texts_of == k] if len(places) < 64 else places[np.searchsorted(places, a):np.searchsorted(places, b)]
            out[k, 1:] = contexts([words[c] for c in codes[a:b]], [(int(p - a), int(kinds[p])) for p in mine])
        return out


def _features(trie: FuzzyTrie):
    def run(batches):
        scorer = Scorer(trie)
        for batch in batches:
            for part in slices(batch, 1):
                made = scorer.features(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.FixedSizeListArray.from_arrays(pa.array(made.ravel()), FEATURES).cast(
                    pa.list_(pa.float64()))], ["label", "features"])

    return run


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 25) -> np.ndarray:
    """Logistic regression by Newton steps; without rows all scores are one half less a little."""
    weights = np.zeros(FEATURES)
    weights[0] = -1e-3
    for _ in range(steps if len(y) else 0):
        p = sigmoid(x @ weights)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(FEATURES)
        weights -= np.linalg.solve(hessian, x.T @ (p - y) + ridge * weights)
    return weights


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text"):
    """(trie, weights) from a bounded sample of labelled rows outside the held-out fold."""
    sample = training_rows(docs.select(id_col, text_of(text_col).alias("_text")), labels.select(id_col, "toxic"), rows, id_col, ["toxic"])
    from .common import materialize

    table = materialize(word_table(sample), "toxic_words")
    n1, n = labels_seen(labels, rows, id_col)
    trie = learn_lexicon(table, (n1 + 1) / (n + 2))
    found = sample.select(F.col("_label_toxic").alias("label"), "_text").mapInArrow(
        _features(trie), f"label {dict(labels.dtypes)['toxic']}, features array<double>").toArrow()
    x = np.array(found["features"].to_pylist(), np.float64).reshape(-1, FEATURES)
    return trie, fit_weights(x, found["label"].to_numpy().astype(np.float64))


def labels_seen(labels: DataFrame, rows: int, id_col: str) -> tuple[int, int]:
    """(toxic, all) labels of the sample."""
    only = labels.select(id_col).distinct()
    picked = training_rows(only, labels.select(id_col, "toxic"), rows, id_col, ["toxic"])
    n1, n = picked.agg(F.sum("_label_toxic"), F.count("*")).first()
    return int(n1 or 0), int(n)


def _score(trie: FuzzyTrie, weights: np.ndarray):
    def run(batches):
        scorer = Scorer(trie)
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sigmoid(scorer.features(part.column(1)) @ weights))], ["_id", "score"])

    return run


def score(docs: DataFrame, trie: FuzzyTrie, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 from one half on).

    Whole texts are read. Null and empty texts, like all texts without hits, get the
    base score; repeated rows get equal scores; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    scored = rows.mapInArrow(_score(trie, weights), f"_id {dict(rows.dtypes)['_id']}, score double")
    return scored.select(F.col("_id").alias(id_col), held_out("_id").alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
