"""Repeated lines go: two Bloom filters find suspects, an exact count confirms them."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, text_of, total_bytes

MIN_CHARS, MIN_DOCS = 20, 3
BITS = 1 << 20              # of a filter segment
MOST_SEGMENTS = 1 << 10     # the broadcast filter has at most 128 MB; with more lines it only suspects more
BYTES_A_BIT = 4             # bytes of text for each bit of a filter
HELD_HASHES = 1 << 21       # hashes a task holds before it hands them on
HOT_SHARE = 200             # keys above this part of all suspected rows are joined by a broadcast of less than so many rows
TRIM = " \t\n\v\f\r"        # fixed: the white space of the contract


def line_keys(texts: pa.Array, min_chars: int):
    """(line bounds of each text, lines, keys, which keys are long enough)."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    lines = pc.list_flatten(lists)
    keys = pc.ascii_lower(pc.utf8_trim(lines, characters=TRIM))
    return bounds, lines, keys, pc.greater_equal(pc.utf8_length(keys), min_chars).to_numpy(zero_copy_only=False)


def _held_keys(texts: pa.Array, min_chars: int):
    """(bounds, for each distinct long key of each text: text and key number, keys as bytes, their hashes)."""
    import xxhash

    bounds, _, keys, long = line_keys(texts, min_chars)
    coded = keys.filter(pa.array(long)).dictionary_encode()
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))[long]
    pairs = np.unique(owner * max(1, len(words)) + coded.indices.to_numpy(zero_copy_only=False))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return bounds, pairs // max(1, len(words)), pairs % max(1, len(words)), words, hashes


def _places(hashes: np.ndarray, segments: int):
    """(segment, two bits in it) of each hash."""
    return ((hashes >> np.uint64(40)) & np.uint64(segments - 1)).astype(np.int64), [
        ((hashes >> np.uint64(shift)) & np.uint64(BITS - 1)).astype(np.uint32) for shift in (0, 20)]


def _filters(min_chars: int, segments: int):
    """Per segment, the bits of hashes seen by this task and of those seen in two documents."""
    def run(batches):
        held, n = [], 0

        def handed():
            hashes, counts = np.unique(np.concatenate(held), return_counts=True)
            segment, bits = _places(hashes, segments)
            order = np.argsort(segment, kind="stable")
            cuts = np.flatnonzero(np.diff(segment[order])) + 1
            for group in np.split(order, cuts):
                both = [np.unique(np.concatenate([b[rows] for b in bits])) for rows in (group, group[counts[group] > 1])]
                yield pa.RecordBatch.from_arrays([pa.array([segment[group[0]]], pa.int32()), *[pa.array([b.astype("<u4").tobytes()]) for b in both]],
                                                 ["segment", "once", "twice"])

        for part in (p for batch in batches for p in slices(batch, 0)):
            _, _, key, _, hashes = _held_keys(part.column(0), min_chars)
            held.append(hashes[key])
            n += len(key)
            if n >= HELD_HASHES:
                yield from handed()
                held, n = [], 0
        if n:
            yield from handed()

    return run


def _bitmap(positions: bytes) -> np.ndarray:
    bits = np.zeros(BITS, bool)
    bits[np.frombuffer(positions, "<u4")] = True
    return np.packbits(bits, bitorder="little")


def _merged(batches):
    """The twice-seen filter of each segment: bits seen in two rows, or twice in one."""
    state: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for segment, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
            seen = state.setdefault(segment, [np.zeros(BITS // 8, np.uint8), np.zeros(BITS // 8, np.uint8)])
            new = _bitmap(once)
            seen[1] |= (seen[0] & new) | _bitmap(twice)
            seen[0] |= new
    for segment, (_, twice) in state.items():
        yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([twice.tobytes()])], ["segment", "bits"])


def twice_seen(rows: DataFrame, min_chars: int, segments: int) -> np.ndarray:
    """Bits (segment, byte) of the keys that two documents may hold; at most ``MOST_SEGMENTS`` segments are collected."""
    parts = rows.select("text").mapInArrow(_filters(min_chars, segments), "segment int, once binary, twice binary")
    merged = parts.repartition("segment").mapInArrow(_merged, "segment int, bits binary").toArrow()
    out = np.zeros((segments, BITS // 8), np.uint8)
    for segment, bits in zip(merged["segment"].to_pylist(), merged["bits"].to_pylist()):
        out[segment] = np.frombuffer(bits, np.uint8)
    return out


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _flagged(filters, min_chars: int, segments: int):
    def run(batches):
        bits = filters.value
        for part in (p for batch in batches for p in slices(batch, 2)):
            bounds, owner, key, words, hashes = _held_keys(part.column(2), min_chars)
            segment, places = _places(hashes, segments)
            likely = np.ones(len(hashes), bool)
            for place in places:
                likely &= (bits[segment, place >> 3] >> (place & 7) & 1).astype(bool)
            digests = [_digest(w) if s else None for w, s in zip(words, likely.tolist())]
            suspected = likely[key]
            ends = np.searchsorted(owner[suspected], np.arange(part.num_rows + 1)).astype(np.int32)
            values = pa.array([digests[k] for k in key[suspected].tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(ends), values)],
                                             ["row", "id", "text", "n_lines", "suspects"])

    return run


def _cut(min_chars: int):
    def run(batches):
        for part in (p for batch in batches for p in slices(batch, 1)):
            bounds, lines, keys, long = line_keys(part.column(1), min_chars)
            kept, dropped = [], []
            for i, gone in enumerate(part.column(3).to_pylist()):
                if not gone:
                    kept.append(part.column(1)[i].as_py())
                    dropped.append(0)
                    continue
                a, n = int(bounds[i]), int(bounds[i + 1] - bounds[i])
                gone, own = set(gone), keys.slice(a, n).cast(pa.binary()).to_pylist()
                stays = [not (big and _digest(k) in gone) for k, big in zip(own, long[a:a + n].tolist())]
                kept.append("\n".join(t for t, s in zip(lines.slice(a, n).to_pylist(), stays) if s))
                dropped.append(n - sum(stays))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())],
                                             ["id", "n_lines", "n_dropped", "kept"])

    return run


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                        min_docs: int = MIN_DOCS, most_segments: int = MOST_SEGMENTS) -> DataFrame:
    """One row per input row: ``id_col``, ``n_lines``, ``n_dropped``, ``kept`` (the text that stays).

    A line's key is the line without white space at both ends, ASCII letters in
    lower case. Keys of ``min_chars`` code points or more that ``min_docs`` rows hold
    lose all their lines but those of the rows of the largest id. A null or
    empty text is one empty line; each row counts as a document, also where ids
    repeat (rows that share the largest id all keep the line); null ids are less than
    all others. Other columns are ignored; an empty table gives no rows.

    Each task sets bits for the line hashes it meets in a once-seen filter, and
    in a twice-seen filter for those of two documents. Bits travel as positions to
    their segment, where filters of all tasks meet: a bit in two once-seen filters
    is twice-seen. Only lines whose bits are all twice-seen are suspected; their
    128-bit digests are counted exactly. The filter has a bit for every
    ``BYTES_A_BIT`` bytes up to ``most_segments`` segments, which bounds its
    broadcast; beyond that more lines are suspected, none is missed. Texts with a suspect
    cross one shuffle to meet their verdicts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    size = total_bytes(rows)
    segments = min(most_segments, 1 << max(0, (size // (BYTES_A_BIT * BITS)).bit_length()))
    filters = spark.sparkContext.broadcast(twice_seen(rows, min_chars, segments))
    id_type = rows.schema["id"].dataType.simpleString()
    flagged = materialize(rows.mapInArrow(_flagged(filters, min_chars, segments), f"row long, id {id_type}, text string, n_lines long, suspects array<binary>"), "suspected_lines")
    held = flagged.select("row", "id", F.explode("suspects").alias("digest"))
    found = held.groupBy("digest").agg(F.count("*").alias("n"), F.max("id").alias("keep")).filter(F.col("n") >= min_docs)
    found = materialize(found, "repeated_lines")
    # fewer than HOT_SHARE keys can each hold that share of the suspected rows
    often = F.col("n") > (flagged.agg(F.sum(F.size("suspects"))).first()[0] or 0) // HOT_SHARE
    hot = F.broadcast(found.filter(often))
    verdicts = held.join(hot, "digest").unionByName(held.join(hot.select("digest"), "digest", "left_anti").join(found.filter(~often), "digest"))
    gone = verdicts.filter(~F.col("id").eqNullSafe(F.col("keep"))).groupBy("row").agg(F.collect_list("digest").alias("gone"))
    clean, touched = flagged.filter(F.size("suspects") == 0), flagged.filter(F.size("suspects") > 0).select("row", "id", "text", "n_lines")
    cut = touched.join(gone, "row", "left").select("id", "text", "n_lines", "gone")
    cut = cut.mapInArrow(_cut(min_chars), f"id {id_type}, n_lines long, n_dropped long, kept string")
    out = clean.select("id", "n_lines", F.lit(0).cast("long").alias("n_dropped"), F.col("text").alias("kept")).unionByName(cut)
    return out.select(F.col("id").alias(id_col), "n_lines", "n_dropped", "kept")
