"""SimHash near-duplicates: Golay codeword keys find fingerprints that differ in few bits."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, small_side, text_of, tidy

SHINGLE = 4
DISTANCE = 4
SEED = 42
BIN_ROWS = 100_000          # fingerprints of one key compared in memory; larger bins go by midpoints
GENERATOR = 0b101011100011  # fixed: generator polynomial of the binary Golay code of length 23
SEGMENTS = ((0, 22), (22, 21), (43, 21))    # (low bit, bits); shorter than 23, so filled up with zeros
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes) -> int:
    """64-bit SimHash of the text's word shingles; zero without words."""
    import xxhash

    words = text.translate(LOWER).split()       # bytes split at exactly the contract's white space
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - SHINGLE + 1)
    last = ends[SHINGLE - 1:] if len(words) >= SHINGLE else ends[-1:]
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    spans = list(zip(starts[:n].tolist(), last.tolist()))
    for at in range(0, n, 1 << 16):
        hashes = np.array([digest(line[a:b], SEED) for a, b in spans[at:at + (1 << 16)]], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for batch in batches:
        for part in slices(batch, 1):
            values = np.array([fingerprint(t.encode()) for t in part.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values.view(np.int64))], ["_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, fp`` (the fingerprint as a signed 64-bit integer) of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text"))
    return rows.mapInArrow(tidy(_fingerprints), "_id long, fp long")


@lru_cache
def syndromes() -> np.ndarray:
    """The remainder of each 23-bit word by the generator polynomial, as a table over 2^23 words."""
    table = np.zeros(1, np.int16)
    for bit in range(23):       # linear: a word's remainder is that of its bits together
        rest = 1 << bit
        for high in range(bit, 10, -1):
            if rest >> high & 1:
                rest ^= GENERATOR << (high - 11)
        table = np.concatenate([table, table ^ np.int16(rest)])
    return table


@lru_cache
def near_patterns() -> np.ndarray:
    """For each remainder the error patterns of weight 4 at most that lead to a codeword: one, or one and five.

    The code is perfect with radius 3: one pattern has weight 3 or less. Two words
    at distance 2 at most have a word between them whose codeword is within 4 of
    both, so they share a codeword among these.
    """
    table, found = syndromes(), [[] for _ in range(1 << 11)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            pattern = sum(1 << b for b in bits)
            found[table[pattern]].append(pattern)
    return np.array([p + [-1] * (6 - len(p)) for p in found], np.int32)


def codewords(words: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords near each 23-bit word: n x 6, -1 where there is none."""
    patterns = near_patterns()[syndromes()[words]]
    return np.where(patterns < 0, -1, (words[:, None] ^ patterns) >> 11)


def keys(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, keys): two values that differ in 4 bits at most share a key.

    Either no segment has over two errors: then all three share a codeword, a key
    of 36 bits. Or one segment has three or four: then of the other two one is equal
    and the other has one error at most: its bits and a codeword are a key.
    """
    values = values.astype(np.uint64)
    parts = [(values >> np.uint64(low) & np.uint64((1 << bits) - 1)).astype(np.int64) for low, bits in SEGMENTS]
    near = [codewords(p).astype(np.int64) for p in parts]
    rows, found = [], []
    for x in range(6):
        for y in range(6):
            for z in range(6):
                ok = np.flatnonzero((near[0][:, x] >= 0) & (near[1][:, y] >= 0) & (near[2][:, z] >= 0))
                rows.append(ok)
                found.append(near[0][ok, x] << 24 | near[1][ok, y] << 12 | near[2][ok, z])
    for kind, (same, other) in enumerate([(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)], 1):
        for x in range(6):
            ok = np.flatnonzero(near[other][:, x] >= 0)
            rows.append(ok)
            found.append(np.int64(kind) << 36 | parts[same][ok] << 12 | near[other][ok, x])
    return np.concatenate(rows), np.concatenate(found)


def _emit_keys(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            values = batch.column(0).slice(at, 4096).to_numpy()
            rows, found = keys(values.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(values[rows])], ["key", "fp"])


class Forest:
    """Union-find over the fingerprints of one task; the smallest is the root."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while x != root:
            self.parent[x], x = root, self.parent.get(x, x)
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def link_bin(values: np.ndarray, forest: Forest, distance: int = DISTANCE) -> None:
    """Unite the values of one bin that are linked: each value met is compared with those not met yet."""
    left, front = values[1:], [values[0]]
    while len(left):
        if not front:
            front, left = [left[0]], left[1:]
            continue
        value = front.pop()
        close = np.bitwise_count((left ^ value).view(np.uint64)) <= distance    # signed counts drop the sign
        for other in left[close]:
            forest.union(int(value), int(other))
            front.append(other)
        left = left[~close]


def _link(bin_rows: int, distance: int):
    """Sorted (key, fp) rows to the edges of a forest; bins over the bound come out as lone fingerprints."""

    def run(batches):
        forest, held, held_key, large = Forest(), [], None, False

        def close():
            if held and not large:
                values = np.unique(np.concatenate(held))
                if len(values) > 1:
                    link_bin(values, forest, distance)

        def lone(values):
            return pa.RecordBatch.from_arrays([pa.array(values), pa.nulls(len(values), pa.int64())], ["a", "b"])

        for batch in batches:
            key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            stops = np.append(cuts[1:], len(key))
            # most keys have one row and link nothing: only longer runs and the edges of the batch are walked
            for i in np.flatnonzero((stops - cuts > 1) | (cuts == 0) | (stops == len(key))):
                a, b = cuts[i], stops[i]
                if key[a] != held_key:
                    close()
                    held, held_key, large = [], key[a], False
                held.append(fp[a:b])
                if large or sum(map(len, held)) > bin_rows:
                    for part in held:
                        yield lone(part)
                    held, large = [], True
        close()
        pairs = [(x, forest.find(x)) for x in list(forest.parent)]
        pairs = np.array([p for p in pairs if p[0] != p[1]], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _midpoints(radius: int):
    """Each value with all values within ``radius`` bits."""

    def run(batches):
        masks = np.array([sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(64), r)], np.uint64)
        for batch in batches:
            for value in batch.column(0).to_numpy():
                middle = (masks ^ value.view(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(middle), pa.array(np.full(len(middle), value))], ["middle", "fp"])

    return run


def links(distinct: DataFrame, distance: int = DISTANCE, bin_rows: int = BIN_ROWS) -> DataFrame:
    """Edges ``a, b`` (b smaller) with the connected components of all links of ``distinct`` (column fp).

    A key's fingerprints are ordered in one place and only forest edges leave a
    task. Bins over ``bin_rows`` are linked by midpoints: values with a common
    value within two bits are linked, and each link of four bits has such a value.
    """
    keyed = distinct.mapInArrow(tidy(_emit_keys), "key long, fp long")
    found = (keyed.repartition("key").sortWithinPartitions("key", "fp")
             .mapInArrow(tidy(_link(bin_rows, distance)), "a long, b long"))
    found = materialize(found.distinct(), "links")
    crowded = found.filter("b is null").select("a")
    middles = crowded.mapInArrow(_midpoints(distance // 2), "middle long, fp long")
    stars = middles.groupBy("middle").agg(F.min("fp").alias("b"))
    rest = middles.join(stars, "middle").filter("fp > b").select(F.col("fp").alias("a"), "b").distinct()
    edges = found.filter("b is not null")
    return edges if crowded.isEmpty() else edges.unionByName(rest)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``a, b``: each vertex that is not the smallest of its component, with the smallest.

    Large-star and small-star steps: every vertex hangs its neighbours on the
    smallest one it sees, until nothing moves. Only minima are grouped, so a
    vertex with very many neighbours is combined before the shuffle.
    """
    edges = materialize(edges, name)
    moved = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.filter("m < a").select("a", F.col("m").alias("b"))).distinct())
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(small_least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(small_least.select("a", F.col("m").alias("b"))).distinct())
        edges = materialize(small, name)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == moved:
            return edges
        moved = state


def _grouped(rows: DataFrame, first: Column, distance: int, bin_rows: int) -> DataFrame:
    """The rows (``fp`` and others) with ``first``, the least of their component; equal fingerprints collapse before keys are made."""
    distinct = materialize(rows.groupBy("fp").agg(F.min(first).alias("_first")), "distinct")
    hung = components(links(distinct.select("fp"), distance, bin_rows)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    rooted = distinct.join(hung, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("_first").alias("first")), "root")
    return rows.join(named.select("fp", "first"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE,
                    bin_rows: int = BIN_ROWS) -> DataFrame:
    """One row per input row: id, ``fp`` (signed), ``component_id``: the smallest id it can reach by links.

    Equal fingerprints collapse to one before keys are made, so copies cost
    nothing more. Null and empty texts have fingerprint zero and link like any
    other; texts of any length are read whole; rows with a null id get their component too, null ids never name one
    unless all are null. An empty table gives no rows.
    """
    if distance > 4:
        raise ValueError("the keys find links of four bits at most")
    rows = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    return _grouped(rows, F.col("_id"), distance, bin_rows).select(F.col("_id").alias(id_col), "fp", F.col("first").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE,
                         bin_rows: int = BIN_ROWS) -> DataFrame:
    """One document of each component stays; all columns are kept.

    A document is an id with a text: the smallest id stays, null ids come last,
    of one id with several texts the one whose text has the least hash. Other
    texts of an id that goes are judged by themselves. Rows that repeat id and text stay
    or go together (exact duplicates are another operator's task).
    """
    own = F.xxhash64(text_of(text_col))
    rows = docs.select(F.col(id_col).alias("_id"), own.alias("_text_hash"), text_of(text_col).alias("_text"))
    keyed = rows.select(F.struct("_id", "_text_hash").alias("_key"), "_text").mapInArrow(
        tidy(_fingerprints), f"_id struct<_id:{docs.schema[id_col].dataType.simpleString()},_text_hash:bigint>, fp long")
    keyed = materialize(keyed.select("_id._id", "_id._text_hash", "fp"), "fingerprints")
    order = F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_text_hash").alias("hash"))
    gone = _grouped(keyed, order, distance, bin_rows).filter(order != F.col("first")).select("_id", "_text_hash").distinct()
    gone = small_side(materialize(gone, "near_copies"))
    return docs.join(gone, F.col(id_col).eqNullSafe(gone["_id"]) & (own == gone["_text_hash"]), "left_anti").select(*docs.columns)
