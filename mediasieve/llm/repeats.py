"""Repeated passages by prefix-free parsing: remove what an earlier document already has.

Triggers are the leftmost minima of a rolling hash over every window of
``LENGTH - TRIGGER + 1`` positions, so each string of LENGTH bytes holds one and
equal strings hold it at the same place. The phrase of a trigger (all strings of
LENGTH bytes that it is the minimum of) is a word of the dictionary; a document is
parsed into triggers. Corpus order is needed to a depth of LENGTH bytes only:

1. a trigger that one document has orders apart from all others and is done;
2. a trigger that always stands in the same phrase takes its smallest document id;
3. the phrases of other triggers meet in a suffix array, where strings with a common
   prefix of LENGTH bytes are neighbours and take their smallest id. Triggers with
   very many phrases are dealt by the hash of each string instead.

Documents are handled in slices dealt by a hash of the row. Slices and buckets of
triggers exchange packed arrays, each trigger once per slice.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, text_of, total_bytes

LENGTH = 50
TRIGGER = 16
SLICE_BYTES = 4 << 20       # text of a slice, about
BUCKET_BYTES = 6 << 20      # text whose triggers meet in a bucket, about
CROWDED = 4096              # phrases of a trigger above this are dealt by string
ORDERED = 200_000           # strings ordered at a time
CHUNK = 1 << 16             # bytes hashed at a time, so that arrays stay in the cache
ODD, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
PLACE = np.uint64((1 << 18) - 1)
RESOLVED, OPEN, SPLIT = 0, 1, 2
NO_ID = np.iinfo(np.int64).max
EXCHANGE = "slice int, bucket int, kind int, a binary, b binary, c binary, d binary, e binary, base long"


def spread(x: np.ndarray) -> np.ndarray:
    """Mix the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(29))) * SPREAD
    return x ^ (x >> np.uint64(32))


def rolling(data: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` bytes, put together from hashes of powers of two."""
    with np.errstate(over="ignore"):
        hashes, size, factor = data.astype(np.uint64) + np.uint64(1), 1, ODD
        result, held, shift = None, 0, np.uint64(1)
        while True:
            if length & size:
                if result is None:
                    result, shift = hashes, factor
                else:
                    n = len(data) - held - size + 1
                    result, shift = result[:n] + shift * hashes[held:held + n], shift * factor
                held += size
            if 2 * size > length:
                return spread(result)
            hashes, size, factor = hashes[:-size] + factor * hashes[size:], 2 * size, factor * factor


def least_places(hashes: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum in each window of ``width`` hashes (their high 46 bits)."""
    low, size = (hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64), 1
    while 2 * size <= width:
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    if size < width:
        low = np.minimum(low[:size - width], low[width - size:])
    return (low & PLACE).astype(np.int64)


class Slice:
    """The documents of a slice in id order, parsed into trigger occurrences.

    Per occurrence: ``doc`` (rank in the slice), ``first`` and ``last`` (its string
    starts in ``data``), ``hash`` of the trigger, ``phrase`` (hash of the phrase and
    the trigger's place there).
    """

    def __init__(self, table: pa.Table):
        ids, texts = table["doc_id"].to_pylist(), table["text"].to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        self.ids = [ids[i] for i in order]
        raw = [texts[i].encode() for i in order]
        # a null id comes after every other, so it is never an earlier document
        self.rank = np.array([NO_ID if i is None else i for i in self.ids], np.int64)
        self.bounds = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        found = [self._parse(at) for at in range(0, max(0, len(self.data) - LENGTH + 1), CHUNK)]
        place, self.first, self.last, self.hash, left, right = (
            np.concatenate([f[k] for f in found]) if found else np.zeros(0, kind)
            for k, kind in enumerate([np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64]))
        if len(place):      # a run of starts cut by a chunk's end is one occurrence
            new = np.r_[True, place[1:] != place[:-1]]
            stop = np.r_[new[1:], True]
            place, self.first, self.hash, left = place[new], self.first[new], self.hash[new], left[new]
            self.last, right = self.last[stop], right[stop]
        self.doc = np.searchsorted(self.bounds, self.first, side="right") - 1
        # a phrase is under 2 LENGTH, so its first and last string and its shape tell it
        shape = ((place - self.first) * 128 + self.last - self.first).astype(np.uint64)
        with np.errstate(over="ignore"):
            self.phrase = spread(left + spread(right * ODD + shape))

    def _parse(self, at: int):
        part = self.data[at:at + CHUNK + LENGTH - 1]
        h, whole = rolling(part, TRIGGER), rolling(part, LENGTH)
        of = least_places(h, LENGTH - TRIGGER + 1)
        starts = np.arange(at, at + len(of))
        inside = np.flatnonzero(starts + LENGTH <= self.bounds[np.searchsorted(self.bounds, starts, side="right")])
        if not len(inside):
            return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 3
        cut = np.flatnonzero(np.r_[True, of[inside[1:]] != of[inside[:-1]]])
        first, last = inside[cut], inside[np.append(cut[1:], len(inside)) - 1]
        # triggers are small hashes; mixed once more they fill the buckets evenly
        return of[first] + at, first + at, last + at + 1, spread(h[of[first]] + ODD), whole[first], whole[last]

    def string_hashes(self, starts: np.ndarray) -> np.ndarray:
        """Hash of the string at each start."""
        out = np.zeros(len(starts), np.uint64)
        for at in range(0, len(starts), CHUNK // LENGTH):
            some = starts[at:at + CHUNK // LENGTH]
            rows = np.lib.stride_tricks.sliding_window_view(self.data, LENGTH)[some].reshape(-1)
            out[at:at + len(some)] = rolling(rows, LENGTH)[::LENGTH]
        return out


def buckets_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Bucket by the high bits: buckets are ranges of hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def low_bytes(values: np.ndarray, n: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :n].tobytes()


def from_low_bytes(data: bytes, n: int) -> np.ndarray:
    wide = np.zeros((len(data) // n, 8), np.uint8)
    wide[:, :n] = np.frombuffer(data, np.uint8).reshape(-1, n)
    return wide.reshape(-1).view("<u8").astype(np.uint64)


def ids_packed(ids: np.ndarray) -> tuple[bytes, int, int]:
    """Ids as differences to the smallest, in as few bytes as the largest needs."""
    base = int(ids.min()) if len(ids) else 0
    with np.errstate(over="ignore"):
        rest = ids.astype(np.uint64) - np.int64(base).astype(np.uint64)
    width = max(1, (int(rest.max()).bit_length() + 7) // 8) if len(ids) else 1
    return low_bytes(rest, width), base, width


def ids_unpacked(data: bytes, base: int, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        return (from_low_bytes(data, len(data) // n) + np.int64(base).astype(np.uint64)).view(np.int64)


def rows_of(rows: list[tuple]) -> pa.Table:
    names = [f.split() for f in EXCHANGE.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.Table.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, names)], [n for n, _ in names])


def runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal keys in sorted arrays."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _announce(n_buckets: int):
    """A slice to its buckets: each trigger once, with its phrase, smallest id and what repeats here."""

    def run(key, table):
        s = Slice(table)
        order = np.argsort(s.hash, kind="stable")       # occurrences stand in document order
        hashes, doc, phrase = s.hash[order], s.doc[order], s.phrase[order]
        cut = runs(hashes)
        if not len(cut):
            return rows_of([])
        count = np.diff(np.append(cut, len(hashes)))
        several = np.minimum.reduceat(phrase, cut) != np.maximum.reduceat(phrase, cut)
        least, most = s.rank[np.minimum.reduceat(doc, cut)], np.maximum.reduceat(doc, cut)
        flags = (np.minimum.reduceat(doc, cut) != most) | several.astype(np.uint8) << 1
        hashes, phrase, bucket = hashes[cut], phrase[cut], buckets_of(hashes[cut], n_buckets)
        rows, ends = [], np.searchsorted(bucket, np.arange(n_buckets + 1))
        for b in range(n_buckets):
            p, q = ends[b], ends[b + 1]
            if p < q:
                ids, base, _ = ids_packed(least[p:q])
                rows.append((key[0].as_py(), b, 0, low_bytes(hashes[p:q], 6), low_bytes(phrase[p:q], 5), ids,
                             flags[p:q].astype(np.uint8).tobytes(), count[p:q][several[p:q]].astype("<u4").tobytes(), base))
        return rows_of(rows)

    return freed(run)


def _resolve(crowded: int):
    """A bucket back to its slices: shared triggers with their state and smallest id."""

    def run(key, table):
        rows = table.to_pylist()
        hashes = np.concatenate([from_low_bytes(r["a"], 6) for r in rows])
        phrase = np.concatenate([from_low_bytes(r["b"], 5) for r in rows])
        sizes = [len(r["a"]) // 6 for r in rows]
        ids = np.concatenate([ids_unpacked(r["c"], r["base"], n) for r, n in zip(rows, sizes)])
        flags = np.frombuffer(b"".join(r["d"] for r in rows), np.uint8)
        counts = np.ones(len(hashes), np.int64)
        counts[flags & 2 > 0] = np.frombuffer(b"".join(r["e"] for r in rows), "<u4")
        order = np.argsort(hashes, kind="stable")
        cut = runs(hashes[order])
        over = lambda f, x: f.reduceat(x[order], cut)
        least = over(np.minimum, ids)
        shared = (least != over(np.maximum, ids)) | (over(np.bitwise_or, flags) & 1 > 0)
        several = (over(np.minimum, phrase) != over(np.maximum, phrase)) | (over(np.bitwise_or, flags) & 2 > 0)
        state = np.where(several, np.where(over(np.add, counts) > crowded, SPLIT, OPEN), RESOLVED).astype(np.uint8)
        group = np.empty(len(hashes), np.int64)
        group[order] = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(hashes))))
        tell = shared[group] & ((state[group] != RESOLVED) | (ids != least[group]) | (flags & 1 > 0))
        out, at = [], 0
        for row, n in zip(rows, sizes):
            mine = np.flatnonzero(tell[at:at + n]) + at
            if len(mine):
                packed, base, _ = ids_packed(least[group[mine]])
                out.append((row["slice"], row["bucket"], 1, low_bytes(hashes[mine], 6), state[group[mine]].tobytes(), packed,
                            None, None, base))
            at += n
        return rows_of(out)

    return freed(run)


def _told(s: Slice, rows: list[dict], n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """State (-1: not shared) and smallest id of each occurrence's trigger."""
    order = np.argsort(s.hash, kind="stable")
    hashes = s.hash[order]
    ends = np.searchsorted(buckets_of(hashes, n_buckets), np.arange(n_buckets + 1))
    state, least = np.full(len(hashes), -1, np.int64), np.full(len(hashes), NO_ID, np.int64)
    for row in rows:
        mine = slice(ends[row["bucket"]], ends[row["bucket"] + 1])
        known = from_low_bytes(row["a"], 6)
        sort = np.argsort(known)
        low = hashes[mine] & np.uint64((1 << 48) - 1)
        spot = np.minimum(np.searchsorted(known, low, sorter=sort), len(known) - 1)
        hit = known[sort[spot]] == low
        state[mine] = np.where(hit, np.frombuffer(row["b"], np.uint8)[sort[spot]], -1)
        least[mine] = np.where(hit, ids_unpacked(row["c"], row["base"], len(known))[sort[spot]], NO_ID)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return state[back], least[back]


def split_strings(s: Slice, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurrence, string start) of every string of a crowded trigger."""
    some = np.flatnonzero(state == SPLIT)
    n = s.last[some] - s.first[some]
    starts = np.repeat(s.first[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return np.repeat(some, n), starts


def _phrases(n_buckets: int):
    """A slice to the buckets: phrases of open triggers and strings of crowded ones, each once."""

    def run(key, table, told):
        s = Slice(table)
        state, _ = _told(s, told.to_pylist(), n_buckets)
        open_ = np.flatnonzero(state == OPEN)
        of, starts = split_strings(s, state)
        name = np.concatenate([s.phrase[open_], s.string_hashes(starts)])
        doc = np.concatenate([s.doc[open_], s.doc[of]])
        begin = np.concatenate([s.first[open_], starts])
        size = np.concatenate([s.last[open_] - s.first[open_], np.ones(len(starts), np.int64)]) + LENGTH - 1
        bucket = np.concatenate([buckets_of(s.hash[open_], n_buckets), buckets_of(name[len(open_):], n_buckets)])
        order = np.lexsort((doc, name, bucket))
        cut = runs(name[order], bucket[order])
        if not len(cut):
            return rows_of([])
        stop = np.append(cut[1:], len(order)) - 1
        several = (doc[order[cut]] != doc[order[stop]]).astype(np.uint8)
        pick, rows = order[cut], []
        ends = np.searchsorted(bucket[pick], np.arange(n_buckets + 1))
        for b in np.flatnonzero(np.diff(ends)):
            mine = pick[ends[b]:ends[b + 1]]
            n = size[mine]
            at = np.repeat(begin[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            ids, base, _ = ids_packed(s.rank[doc[mine]])
            flags = several[ends[b]:ends[b + 1]]
            rows.append((key[0].as_py(), int(b), 2, low_bytes(name[mine], 8), s.data[at].tobytes(), ids, n.astype(np.uint8).tobytes(),
                         flags.tobytes(), base))
        return rows_of(rows)

    return freed(run)


def suffix_order(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the strings at ``starts``, whether each equals the one before): a suffix array to depth LENGTH."""
    rows = np.zeros((len(starts), -(-LENGTH // 8) * 8), np.uint8)
    rows[:, :LENGTH] = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[starts]
    words = rows.view(">u8")
    order = np.lexsort(tuple(words[:, i].astype(np.uint64) for i in range(words.shape[1] - 1, -1, -1)))
    same = np.ones(len(starts), bool)
    same[:1] = False
    for i in range(words.shape[1]):
        word = words[order, i]
        same[1:] &= word[1:] == word[:-1]
    return order, same


def _least_ids(mine: np.ndarray, hashes, data, starts, unit, ids, several) -> tuple[np.ndarray, np.ndarray]:
    """(strings that several documents have, smallest id): by a suffix array of those whose hash repeats."""
    order = mine[np.argsort(hashes[mine], kind="stable")]
    cut = runs(hashes[order])
    if not len(cut):
        return mine, np.zeros(0, np.int64)
    of = unit[order]
    met = np.minimum.reduceat(ids[of], cut) != np.maximum.reduceat(ids[of], cut)
    met |= np.logical_or.reduceat(several[of], cut)
    some = order[np.repeat(met, np.diff(np.append(cut, len(order))))]
    least = np.empty(len(some), np.int64)
    if len(some):
        order, same = suffix_order(data, starts[some])
        cut = np.flatnonzero(~same)
        least[order] = np.repeat(np.minimum.reduceat(ids[unit[some]][order], cut), np.diff(np.append(cut, len(order))))
    return some, least


def _sort_phrases(key, table):
    """A bucket's phrases in suffix order; back to the slices: runs of starts with a smaller id."""
    rows = table.to_pylist()
    sizes = [len(r["a"]) // 8 for r in rows]
    name = np.concatenate([from_low_bytes(r["a"], 8) for r in rows])
    data = np.frombuffer(b"".join(r["b"] for r in rows), np.uint8)
    length = np.frombuffer(b"".join(r["d"] for r in rows), np.uint8).astype(np.int64)
    ids = np.concatenate([ids_unpacked(r["c"], r["base"], n) for r, n in zip(rows, sizes)])
    several = np.frombuffer(b"".join(r["e"] for r in rows), np.uint8) > 0
    n = length - LENGTH + 1
    unit = np.repeat(np.arange(len(n), dtype=np.int32), n)
    offset = (np.arange(len(unit)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int16)
    starts = np.repeat((np.cumsum(length) - length).astype(np.int32), n) + offset
    hashes = np.empty(len(starts), np.uint64)
    for a in range(0, len(data) - LENGTH + 1, CHUNK):
        p, q = np.searchsorted(starts, [a, a + CHUNK])
        hashes[p:q] = rolling(data[a:a + CHUNK + LENGTH - 1], LENGTH)[starts[p:q] - a]
    # equal strings have equal hashes, so ranges of hashes are ordered one after the other
    parts = 1 + len(hashes) // ORDERED
    part = buckets_of(hashes, parts).astype(np.int32)
    found = [_least_ids(np.flatnonzero(part == k), hashes, data, starts, unit, ids, several) for k in range(parts)]
    some, least = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    order = np.argsort(some)
    some, least = some[order], least[order]
    tell = (least < ids[unit[some]]) | several[unit[some]]
    some, least = some[tell], least[tell]
    if not len(some):
        return rows_of([])
    begin = np.r_[True, (unit[some][1:] != unit[some][:-1]) | (offset[some][1:] != offset[some][:-1] + 1) | (least[1:] != least[:-1])]
    cut = np.flatnonzero(begin)
    stop = np.append(cut[1:], len(some)) - 1
    u, t0, t1, m = unit[some[cut]], offset[some[cut]], offset[some[stop]] + 1, least[cut]
    ends = np.searchsorted(u, np.concatenate([[0], np.cumsum(sizes)]))
    out = []
    for row, a, b in zip(rows, ends[:-1], ends[1:]):
        if a < b:
            packed, base, _ = ids_packed(m[a:b])
            out.append((row["slice"], row["bucket"], 3, low_bytes(name[u[a:b]], 8), t0[a:b].astype(np.uint8).tobytes(), packed,
                        t1[a:b].astype(np.uint8).tobytes(), None, base))
    return rows_of(out)


def covered(s: Slice, told: list[dict], runs_told: list[dict], n_buckets: int) -> np.ndarray:
    """For each byte of the slice whether it goes."""
    state, least = _told(s, told, n_buckets)
    begins, ends = [], []
    gone = (state == RESOLVED) & (least < s.rank[s.doc]) if len(s.doc) else np.zeros(0, bool)
    begins.append(s.first[gone])
    ends.append(s.last[gone] + LENGTH - 1)
    if runs_told:
        name = np.concatenate([from_low_bytes(r["a"], 8) for r in runs_told])
        t0 = np.frombuffer(b"".join(r["b"] for r in runs_told), np.uint8).astype(np.int64)
        t1 = np.frombuffer(b"".join(r["d"] for r in runs_told), np.uint8).astype(np.int64)
        m = np.concatenate([ids_unpacked(r["c"], r["base"], len(r["a"]) // 8) for r in runs_told])
        order = np.argsort(name, kind="stable")
        name, t0, t1, m = name[order], t0[order], t1[order], m[order]
        open_ = np.flatnonzero(state == OPEN)
        of, starts = split_strings(s, state)
        ask = np.concatenate([s.phrase[open_], s.string_hashes(starts)])
        base, doc = np.concatenate([s.first[open_], starts]), np.concatenate([s.doc[open_], s.doc[of]])
        a, b = np.searchsorted(name, ask), np.searchsorted(name, ask, side="right")
        n = b - a
        run = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        who = np.repeat(np.arange(len(ask)), n)
        hit = m[run] < s.rank[doc[who]]
        begins.append((base[who] + t0[run])[hit])
        ends.append((base[who] + t1[run] + LENGTH - 1)[hit])
    return union(np.concatenate(begins), np.concatenate(ends), len(s.data))


def union(begins: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """For each of n places whether an interval covers it."""
    order = np.argsort(begins, kind="stable")
    begins, ends = begins[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    new = np.ones(len(begins), bool)
    new[1:] = begins[1:] > ends[:-1]
    begins, ends = begins[new], ends[np.append(new[1:], True)] if len(ends) else ends
    turns = np.diff(np.concatenate([[0], np.column_stack([begins, ends]).ravel(), [n]]).astype(np.int64))
    return np.repeat(np.arange(len(turns)) % 2 == 1, turns)


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _cut(n_buckets: int, digest: bool):
    def run(key, table, told):
        rows = told.to_pylist()
        s = Slice(table)
        gone = covered(s, [r for r in rows if r["kind"] == 1], [r for r in rows if r["kind"] == 3], n_buckets)
        removed, spans, kept = [], [], []
        for a, b in zip(s.bounds[:-1], s.bounds[1:]):
            mine = gone[a:b]
            removed.append(int(mine.sum()))
            spans.append(int(mine[:1].sum() + (mine[1:] & ~mine[:-1]).sum()))
            rest = s.data[a:b][~mine].tobytes()
            kept.append(hashlib.sha256(rest).digest() if digest else rest)
        return pa.Table.from_arrays([pa.array(s.ids, pa.int64()), pa.array(np.diff(s.bounds)), pa.array(removed, pa.int64()),
                                     pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return freed(run)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False,
                   slice_bytes: int = SLICE_BYTES, bucket_bytes: int = BUCKET_BYTES, crowded: int = CROWDED) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept``: the bytes left of each text (their SHA-256 with ``digest``).

    A byte goes when a string of LENGTH bytes over it also starts in a document
    with a smaller id. Repeats within one document, or between rows with the same
    id, remove nothing; rows with a null id come after all others and remove
    nothing from each other. Null and empty texts have no bytes; an empty table
    gives no rows. Texts are dealt by one shuffle that all three passes read.
    """
    size = total_bytes(docs, text_col)
    n_slices, n_buckets = max(1, math.ceil(size / slice_bytes)), max(1, math.ceil(size / bucket_bytes))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_slices)).cast("int"))
    slices = rows.groupBy("slice")
    told = slices.applyInArrow(_announce(n_buckets), EXCHANGE).groupBy("bucket").applyInArrow(_resolve(crowded), EXCHANGE)
    phrases = slices.cogroup(told.groupBy("slice")).applyInArrow(_phrases(n_buckets), EXCHANGE)
    answers = phrases.groupBy("bucket").applyInArrow(freed(_sort_phrases), EXCHANGE)
    back = told.unionByName(answers).groupBy("slice")
    return slices.cogroup(back).applyInArrow(_cut(n_buckets, digest), KEPT)
