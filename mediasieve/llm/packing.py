"""Pack documents into full training windows, each seed with its BM25 neighbours."""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import freed, materialize, slices, text_of, tidy
from .tokens import shared_encoder

WINDOW = 2048
SHARD_BYTES = 4 << 20       # text of one index shard, about
TEXT_BYTES = 4 << 20        # of text encoded at once
ID_BYTES = 2 << 20         # bytes of ids whose terms are counted at once
SPAN_COST, POSTING_COST = 400, 10   # of a term's list and of an entry in it, against a term of a document looked through
PLACES = 500_000            # rows of four longs up to which a table of places is broadcast
K1, B = 1.2, 0.75
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "sequence_tokens long")


class Corpus(NamedTuple):
    """Of all documents: how many hold each id, their number, their mean length."""

    df: np.ndarray
    n: int
    mean: float


def term_weights(df, tf, lengths, corpus: Corpus) -> tuple[np.ndarray, np.ndarray]:
    """(BM25 weights of terms in documents, which of them tell documents apart)."""
    idf = np.log1p((corpus.n - df + 0.5) / (df + 0.5))
    weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths / max(1.0, corpus.mean)))
    return weight, (df > 1) & (2 * df <= corpus.n)


class Bm25:
    """An inverted index over the documents of one shard; weights are those of the corpus, or of the shard alone."""

    def __init__(self, ids: np.ndarray, at: np.ndarray, corpus: Corpus | None = None):
        n, lengths = len(at) - 1, np.diff(at)
        self.n = n
        pairs, tf = np.unique(ids.astype(np.int64) * n + np.repeat(np.arange(n), lengths), return_counts=True)
        terms, docs = pairs // n, pairs % n
        first = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.zeros(0, np.int64)
        df = np.diff(np.r_[first, len(terms)])
        held = df if corpus is None else corpus.df[terms[first]]
        weight, useful = term_weights(np.repeat(held, df), tf, lengths[docs], corpus or Corpus(df, n, lengths.mean() if n else 0.0))
        term = np.repeat(np.arange(len(df)), df)[useful]
        self.docs, self.weights = docs[useful], weight[useful]
        self.ptr = np.searchsorted(term, np.arange(len(df) + 1))
        self.held = np.diff(self.ptr)
        order = np.argsort(self.docs, kind="stable")
        self.query_terms, self.query_ptr = term[order], np.searchsorted(self.docs[order], np.arange(n + 1))
        self.asked, self.room = np.zeros(len(df)), np.zeros(len(term))
        self._leave(np.diff(self.query_ptr) > 0, self.query_terms, self.weights[order], np.diff(self.query_ptr))

    def _leave(self, stay: np.ndarray, terms: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> None:
        """Documents by their terms and weights, in a row: the ones among which a query with many postings looks."""
        self.left, sizes = np.flatnonzero(stay), sizes[stay]
        self.left_terms, self.left_weights, self.left_at = terms, weights, np.cumsum(sizes) - sizes

    def _drop_used(self, used: np.ndarray) -> None:
        """Used documents go once they are a quarter of those looked through."""
        free = ~used[self.left]
        if 4 * np.count_nonzero(free) <= 3 * len(free):
            sizes = np.diff(np.append(self.left_at, len(self.left_terms)))
            kept = np.repeat(free, sizes)
            stay = np.zeros(self.n, bool)
            stay[self.left[free]] = True
            of = np.zeros(self.n, np.int64)
            of[self.left] = sizes
            self._leave(stay, self.left_terms[kept], self.left_weights[kept], of)

    def neighbours(self, doc: int, used: np.ndarray) -> list[int]:
        """Unused documents by falling score, ties to the smaller position."""
        terms = self.query_terms[self.query_ptr[doc]:self.query_ptr[doc + 1]]
        if not len(terms):
            return []
        self._drop_used(used)
        if SPAN_COST * len(terms) + POSTING_COST * int(self.held[terms].sum()) > len(self.left_terms):
            if not len(self.left):
                return []
            self.asked[terms] = 1
            weights = np.take(self.asked, self.left_terms, out=self.room[:len(self.left_terms)], mode="clip")      # no check, no new memory
            self.asked[terms] = 0
            weights *= self.left_weights
            scores = np.add.reduceat(weights, self.left_at)
            hit = scores > 0
            found, scores = self.left[hit], scores[hit]
        else:
            spans = [slice(a, b) for a, b in zip(self.ptr[terms].tolist(), self.ptr[terms + 1].tolist())]
            docs, weights = np.concatenate([self.docs[s] for s in spans]), np.concatenate([self.weights[s] for s in spans])
            found, place = np.unique(docs, return_inverse=True)
            scores = np.bincount(place, weights)
        free = ~used[found]
        found, scores = found[free], scores[free]
        return found[np.lexsort((found, -scores))].tolist()


def packing_order(ids: np.ndarray, at: np.ndarray, seeds: np.ndarray, window: int = WINDOW,
                  corpus: Corpus | None = None) -> list[int]:
    """Documents in packing order: each window's seed, then its unused neighbours until it is full.

    A document cut by the end of a window seeds the next one.
    """
    index, n, lengths = Bm25(ids, at, corpus), len(at) - 1, np.diff(at).tolist()
    used, order, filled, fresh = np.zeros(n, bool), [], 0, iter(seeds.tolist())
    waiting = iter(())
    while len(order) < n:
        doc = next((d for d in waiting if not used[d]), None)
        seed = doc is None
        if seed:
            doc = next(d for d in fresh if not used[d])
        used[doc] = True
        order.append(doc)
        opened = filled // window != (filled + lengths[doc]) // window
        filled += lengths[doc]
        if opened and filled % window == 0:
            waiting = iter(())
        elif opened or seed:
            waiting = iter(index.neighbours(doc, used))
    return order


def window_starts(total: int, window: int = WINDOW) -> np.ndarray:
    """Where sequences start: full windows, then powers of two for the rest, which need no padding."""
    rest, at = total % window, total - total % window
    starts = list(range(0, at, window))
    while rest:
        step = 1 << (rest.bit_length() - 1)
        starts.append(at)
        at, rest = at + step, rest - step
    return np.array(starts, np.int64)


def _encode(tokenizer: str, kind: str, end_id: int):
    def run(batches):
        encoder = shared_encoder(tokenizer, kind)
        for batch in batches:
            for part in slices(batch, 1, TEXT_BYTES):
                flat, at = encoder.encode(part.column(1), end_id)
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(part), [
                    None, pa.py_buffer(4 * np.asarray(at, np.int64)), pa.py_buffer(flat.astype("<u4"))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), ids, part.column(2)], ["doc_id", "ids", "n_bytes"])

    return run


def _flat(held: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all documents in a row, bounds of each) from their bytes."""
    held = held.cast(pa.large_binary())
    _, offsets, data = held.buffers()
    at = np.frombuffer(offsets, np.int64)[held.offset:held.offset + len(held) + 1]
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]].view("<u4"), (at - at[0]) // 4


def _document_terms(ids: np.ndarray, at: np.ndarray):
    """(document, term, times), by document and term."""
    bits = max(1, int(ids.max(initial=0)).bit_length())
    kind = np.uint32 if bits + len(at).bit_length() <= 32 else np.uint64       # half the width sorts in half the time
    pairs, tf = np.unique(np.repeat(np.arange(len(at) - 1, dtype=kind) << kind(bits), np.diff(at)) | ids.astype(kind), return_counts=True)
    return (pairs >> kind(bits)).astype(np.int64), (pairs & kind((1 << bits) - 1)).astype(np.int64), tf


def _counted(batches):
    df = np.zeros(0, np.int64)
    for batch in batches:
        for part in slices(batch, 0, ID_BYTES):
            n = np.bincount(_document_terms(*_flat(part.column(0)))[1])
            df, n = (df, n) if len(df) > len(n) else (n, df)
            df[:len(n)] += n
    terms = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(df[terms], pa.int64())], ["term", "n"])


def corpus_of(encoded: DataFrame) -> Corpus:
    """Document frequencies over all documents: one number per id of the vocabulary."""
    n, mean = encoded.agg(F.count("*"), F.avg(F.octet_length("ids") / 4)).first()
    found = encoded.select("ids").mapInArrow(tidy(_counted), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    terms = found["term"].to_numpy()
    df = np.zeros(int(terms.max(initial=0)) + 1, np.int64)
    df[terms] = found["n"].to_numpy()
    return Corpus(df, n, float(mean or 0))


def heaviest(ids: np.ndarray, at: np.ndarray, corpus: Corpus) -> np.ndarray:
    """Each document's two heaviest terms, ties to the smaller; -1 where there are none."""
    docs, terms, tf = _document_terms(ids, at)
    weight, useful = term_weights(corpus.df[terms], tf, np.diff(at)[docs], corpus)
    docs, terms, weight = docs[useful], terms[useful], weight[useful]
    top = np.full((len(at) - 1, 2), -1, np.int64)
    if not len(docs):
        return top
    starts = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
    sizes = np.diff(np.append(starts, len(docs)))
    for rank in range(2):
        best = np.flatnonzero(weight == np.repeat(np.maximum.reduceat(weight, starts), sizes))
        best = best[np.append(True, docs[best[1:]] != docs[best[:-1]])]     # the smallest of equals: terms rise in a document
        best = best[weight[best] > 0]
        top[docs[best], rank] = terms[best]
        weight[best] = 0
    return top


def _keyed(corpus: Corpus, names: list[str]):
    """The named columns and ``_t1``, ``_t2``: the two heaviest terms."""
    def run(batches):
        for part in (p for batch in batches for p in slices(batch, batch.schema.get_field_index("ids"), ID_BYTES)):
            top = heaviest(*_flat(part.column("ids")), corpus)
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(top[:, 0]), pa.array(top[:, 1])], [*names, "_t1", "_t2"])

    return run


class Dealing(NamedTuple):
    """Parts of large first terms, parts of large pairs of terms, and the shard of each part."""

    seconds: DataFrame
    thirds: DataFrame
    places: DataFrame


def _met(rows: DataFrame, table: DataFrame, by: list[str], how: str) -> DataFrame:
    """A join whose right side is broadcast when a bounded count proves it small, else left to the planner."""
    small = table.limit(PLACES + 1).count() <= PLACES
    return rows.join(F.broadcast(table) if small else table, by, how)


def _parts(sizes: DataFrame, by: list[str], shard_bytes: int) -> DataFrame:
    """As many parts as its size asks for, of each key of more than a shard."""
    large = sizes.groupBy(*by).agg(F.sum("n_bytes").alias("n_bytes")).filter(F.col("n_bytes") > shard_bytes)
    return materialize(large.select(*by, F.ceil(F.col("n_bytes") / shard_bytes).alias("_parts")), "packing_parts")


def _split_up(rows: DataFrame, by: list[str], parts: DataFrame, part: Column, name: str) -> DataFrame:
    return _met(rows, parts, by, "left").withColumn(name, F.pmod(part, F.coalesce("_parts", F.lit(1)))).drop("_parts")


def _running(batches):
    """Bytes before each row in its partition, and the partition."""
    pid, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        sizes = batch.column(batch.schema.get_field_index("n_bytes")).to_numpy()
        ends = before + np.cumsum(sizes)
        before = int(ends[-1]) if len(ends) else before
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([pid] * len(sizes), pa.int64()), pa.array(ends - sizes)], [*batch.schema.names, "_pid", "_before"])


def _placed(rows: DataFrame, dealing: Dealing) -> DataFrame:
    rows = _split_up(rows, ["_t1"], dealing.seconds, F.xxhash64("_t2"), "_p2")
    return _split_up(rows, ["_t1", "_p2"], dealing.thirds, F.col("_row_hash"), "_p3")


def dealing(keys: DataFrame, shard_bytes: int) -> Dealing:
    """How documents are dealt, from narrow rows (``_t1``, ``_t2``, ``_row_hash``, ``n_bytes``).

    Terms of more than a shard are split by the second term, and what is still
    too large (copies) by a hash of the row, each into as many parts as its
    measured size asks for. Parts are numbered by a running sum of their sizes over ranges of
    (term, part): small terms share a shard. Nothing that grows with the input is collected; one sum per
    partition meets in a small window.
    """
    seconds = _parts(keys, ["_t1"], shard_bytes)
    split = _split_up(keys, ["_t1"], seconds, F.xxhash64("_t2"), "_p2")
    thirds = _parts(split, ["_t1", "_p2"], shard_bytes)
    by = ["_t1", "_p2", "_p3"]
    sizes = _split_up(split, by[:2], thirds, F.col("_row_hash"), "_p3").groupBy(*by).agg(F.sum("n_bytes").alias("n_bytes"))
    ordered = materialize(sizes, "packing_sizes").repartitionByRange(*by).sortWithinPartitions(*by)
    runs = materialize(ordered.mapInArrow(_running, "_t1 long, _p2 long, _p3 long, n_bytes long, _pid long, _before long"), "packing_runs")
    base = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)        # one row per partition
    offsets = runs.groupBy("_pid").agg(F.sum("n_bytes").alias("n")).select("_pid", F.coalesce(F.sum("n").over(base), F.lit(0)).alias("_base"))
    shard = F.floor((F.col("_before") + F.col("_base")) / shard_bytes)
    return Dealing(seconds, thirds, materialize(runs.join(offsets, "_pid").select(*by, shard.alias("_shard")), "packing_places"))


def _pack(window: int, seed: int, corpus: Corpus):
    def run(key, table):
        shard = key[0].as_py()
        lists = [_flat(chunk) for chunk in table.column("ids").chunks]
        doc_ids = table.column("doc_id").to_pylist()
        ids, lengths = np.concatenate([f for f, _ in lists]), np.concatenate([np.diff(a) for _, a in lists])
        # a fixed order of rows whatever way the shuffle brings them
        at = np.concatenate([[0], np.cumsum(lengths)])
        sums = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(at[:-1], at[1:])]
        rows = sorted(range(len(doc_ids)), key=lambda i: (doc_ids[i] is None, doc_ids[i] or 0, sums[i]))
        ids = np.concatenate([ids[at[i]:at[i + 1]] for i in rows])
        lengths, doc_ids = lengths[rows], [doc_ids[i] for i in rows]
        at = np.concatenate([[0], np.cumsum(lengths)])
        order = np.array(packing_order(ids, at, np.random.default_rng([seed, shard]).permutation(len(rows)), window, corpus))
        ends = np.cumsum(lengths[order])
        begins = ends - lengths[order]
        sequences = window_starts(int(ends[-1]), window)
        cuts = np.union1d(begins, sequences)
        stops = np.append(cuts[1:], ends[-1])
        place = np.searchsorted(begins, cuts, side="right") - 1
        sequence = np.searchsorted(sequences, cuts, side="right") - 1
        start, size = cuts - begins[place], stops - cuts
        source = at[order[place]] + start
        crc = [zlib.crc32(ids[a:a + n].astype("<u4")) for a, n in zip(source.tolist(), size.tolist())]
        held = np.diff(np.append(sequences, ends[-1]))
        return pa.Table.from_arrays([
            pa.array([doc_ids[i] for i in order[place]], pa.int64()), pa.array(start), pa.array(size), pa.array(crc, pa.int64()),
            pa.array(lengths[order[place]]), pa.array((shard << 32) + sequence), pa.array(cuts - sequences[sequence]),
            pa.array(held[sequence])], [f.split()[0] for f in PIECES.split(", ")])

    return freed(run)


def pack(docs: DataFrame, tokenizer: str, kind: str = "words", end_id: int = 1, window: int = WINDOW, seed: int = 7,
         shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document in a sequence of at most ``window`` ids.

    Documents are encoded once; document frequencies are those of all of them.
    Documents with the same heaviest term are dealt to the same shard of about
    ``shard_bytes`` (see ``dealing``). A shard builds a BM25 index over its
    documents; each window starts with a seed (or the rest of the document the
    last window cut) and takes that seed's best unused neighbours of its shard,
    asked for with all its terms, until it is
    full. Documents are cut where a window ends, so only a shard's last window
    is short; it is split into powers of two, which need no padding. A null or
    empty text is its end id alone; rows with a null or a repeated id are packed
    like others, under the id they have; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.withColumn("n_bytes", (F.octet_length("text") + 1).cast("long"))
    encoded = materialize(rows.mapInArrow(tidy(_encode(tokenizer, kind, end_id)), "doc_id long, ids binary, n_bytes long"), "packing_ids")
    corpus = corpus_of(encoded)
    encoded = encoded.withColumn("_row_hash", F.xxhash64("doc_id", "ids"))
    terms = "_row_hash long, _t1 long, _t2 long"
    keys = encoded.select("n_bytes", "_row_hash", "ids").mapInArrow(tidy(_keyed(corpus, ["n_bytes", "_row_hash"])), f"n_bytes long, {terms}")
    plan = dealing(materialize(keys, "packing_terms"), shard_bytes)
    # the terms are found once more where the ids leave for their shards: less disk than ids with a key written again
    keyed = encoded.select("doc_id", "_row_hash", "ids").mapInArrow(tidy(_keyed(corpus, ["doc_id", "ids", "_row_hash"])), f"doc_id long, ids binary, {terms}")
    dealt = _met(_placed(keyed, plan), plan.places, ["_t1", "_p2", "_p3"], "inner").select("_shard", "doc_id", "ids")
    return dealt.groupBy("_shard").applyInArrow(_pack(window, seed, corpus), PIECES)
