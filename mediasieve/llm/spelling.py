"""Spelling variants: words at one edit, found by walking a trie held as a distributed edge table."""

from __future__ import annotations

import string
import zlib
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices

# fixed: a word of the contract is a run of [A-Za-zÀ-ÿ]; its bytes but for the second of a letter from À on
IS_LETTER = np.isin(np.arange(256), [*map(ord, string.ascii_letters), 0xC3])
TEXT_BYTES, HELD_BYTES = 2 << 20, 16 << 20     # of text searched for runs at once, and of text whose runs are counted together
LEVELS = 16                 # walked one by one; what is still alive then (long words that part late) is looked up
MODULUS, BASE = (1 << 61) - 1, 1_000_003_579
STATE = "wid long, node long, edits int, left string"
EDGE = "node long, c int, child long, wid long, tail long, next long"
BITS = 53                   # of a set of letters; sets a to z apart from most of à to ÿ


def _one_zero_byte() -> np.ndarray:
    """Of each bit of a crc32, what a zero byte after the text makes of it."""
    crc = 1 << np.arange(32, dtype=np.uint32)
    for _ in range(8):
        crc = (crc >> 1) ^ np.where(crc & 1, np.uint32(0xEDB88320), np.uint32(0))
    return crc


def _applied(images: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """The linear map that sends each bit to its image, byte by byte through tables of 256."""
    out = np.zeros_like(crc)
    for at in range(0, 32, 8):
        table = np.zeros(1, np.uint32)
        for image in images[at:at + 8]:
            table = np.concatenate([table, table ^ image])
        out ^= table[(crc >> np.uint32(at)) & np.uint32(255)]
    return out


def _moved(crc: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What stays of checksums when so many bytes follow: crc32(a + b) is this of crc32(a), xor crc32(b)."""
    crc, images = crc.copy(), _one_zero_byte()
    while sizes.any():
        odd = np.flatnonzero(sizes & 1)
        crc[odd] = _applied(images, crc[odd])
        sizes, images = sizes >> 1, _applied(images, images)
    return crc


def _runs(texts: pa.Array, min_length: int) -> tuple[pa.Array, np.ndarray]:
    """(letter runs of at least so many code points, the text of each). In UTF-8, À to ÿ are C3 and one byte more."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data or b"", np.uint8)[bounds[0]:bounds[-1]]
    bounds = bounds - bounds[0]
    leads = data == 0xC3
    letter = IS_LETTER[data]
    letter[1:] |= leads[:-1]
    opens, closes = letter.copy(), letter.copy()
    inner = bounds[(bounds > 0) & (bounds < len(data))]     # a run ends with its text
    opens[1:] &= ~letter[:-1]
    opens[inner] = letter[inner]
    closes[:-1] &= ~letter[1:]
    closes[inner - 1] = letter[inner - 1]
    starts, stops = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    long = stops - starts >= max(1, min_length)
    starts, stops = starts[long], stops[long]
    two = np.concatenate([[0], np.cumsum(leads, dtype=np.int32)])
    long = stops - starts - (two[stops] - two[starts]) >= min_length
    starts, stops = starts[long], stops[long]
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[stops] -= 1
    held = data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
    at = np.concatenate([[0], np.cumsum(stops - starts)])
    runs = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(held))
    return runs, np.searchsorted(bounds, starts, "right") - 1


def _damaged(ids: list, words: pa.Array, of: np.ndarray, codes: np.ndarray, damage_every: int) -> tuple[np.ndarray, np.ndarray]:
    """(occurrences that lose a letter, their checksums), of words ``codes`` in texts ``of``."""
    before = np.array([zlib.crc32(f"{doc_id or ''}:".encode()) for doc_id in ids], np.uint32)
    own = np.array([zlib.crc32(word) for word in words.cast(pa.large_binary()).to_pylist()], np.uint32)
    sizes, kind = np.unique(pc.binary_length(words).to_numpy(zero_copy_only=False), return_inverse=True)
    if len(sizes) * len(before) <= len(codes):      # each text's part of the checksum once for all words of a length
        moved = _moved(np.tile(before, len(sizes)), np.repeat(sizes, len(before)))[kind[codes] * len(before) + of]
    else:
        moved = _moved(before[of], sizes[kind[codes]])
    h = moved ^ own[codes]
    hit = np.flatnonzero(h % np.uint32(damage_every) == 0)
    return hit, h[hit]


def _counted(held: list, min_length: int, damage_every: int) -> pa.RecordBatch:
    """``word``, ``n`` of (ids, runs, the text of each) of some texts; a word that damage makes may stand there twice."""
    firsts = np.cumsum([0, *(len(ids) for ids, _, _ in held)])
    of = np.concatenate([of + first for (_, _, of), first in zip(held, firsts)])
    coded = pa.chunked_array([runs for _, runs, _ in held]).combine_chunks().dictionary_encode()
    words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    n, changed = np.bincount(codes, minlength=len(words)), Counter()
    if damage_every:
        hit, sums = _damaged([doc_id for ids, _, _ in held for doc_id in ids.to_pylist()], words, of, codes, damage_every)
        n -= np.bincount(codes[hit], minlength=len(words))
        for run, h in zip(words.take(pa.array(codes[hit])).to_pylist(), sums.tolist()):
            if len(run) > min_length:
                changed[run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    left = np.flatnonzero(n)
    return pa.RecordBatch.from_arrays([
        pa.concat_arrays([words.take(pa.array(left)), pa.array(list(changed), words.type)]).cast(pa.string()),
        pa.array(np.concatenate([n[left], np.array(list(changed.values()), np.int64)]), pa.int64())], ["word", "n"])


def _counts(min_length: int, damage_every: int):
    def run(batches):
        held, size = [], 0
        for part in (p for batch in batches for p in slices(batch, 1, TEXT_BYTES)):
            held.append((part.column(0), *_runs(pc.ascii_lower(part.column(1)), min_length)))
            size += part.column(1).nbytes
            if size >= HELD_BYTES:
                yield _counted(held, min_length, damage_every)
                held, size = [], 0
        if held:
            yield _counted(held, min_length, damage_every)

    return run


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 5, min_count: int = 3,
                damage_every: int = 0) -> DataFrame:
    """``word``, ``n``: lower-cased letter runs of whole texts, of at least ``min_length`` letters and ``min_count`` occurrences.

    ``damage_every`` plants misspellings: in about every so many (document, word)
    pairs, chosen by crc32, one letter is deleted (0: none; a null id is empty
    in that checksum). Null texts have no words. Rows that repeat count again;
    an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = rows.mapInArrow(_counts(min_length, damage_every), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _chain(start: int, codes) -> list[int]:
    """Ids of all prefixes of ``codes``."""
    out = [start]
    for c in codes:
        out.append((out[-1] * BASE + c + 1) % MODULUS)
    return out


def _paths(word: str):
    """Per direction: (the word in that direction, its code points with an end mark of 0, ids of prefixes)."""
    for side, own in ((1, word), (2, word[::-1])):
        codes = [*map(ord, own), 0]
        yield own, codes, _chain(side, codes)


def _tail(rest: str) -> int:
    """What Spark's ``xxhash64`` gives for the string."""
    import xxhash

    h = xxhash.xxh64_intdigest(rest.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def _edges(batches):
    """Edges of the tries of words and of reversed words, from the depth where a neighbour's edit may stand."""
    names = [c.split()[0] for c in EDGE.split(", ")]
    for part in (p for batch in batches for p in slices(batch, 1, 1 << 18)):
        rows = []
        for wid, word in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            for own, codes, nodes in _paths(word):
                follow = [*(1 << c % BITS for c in codes[1:]), 0]
                rows += [(nodes[d], codes[d], nodes[d + 1], wid, _tail(own[d + 1:]), follow[d]) for d in range((len(word) - 1) // 2, len(codes))]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names)


def _seeds(batches):
    """Both states of each word: halfway down its own path, no edit spent, the rest of it left."""
    for part in (p for batch in batches for p in slices(batch, 1, 1 << 18)):
        wids, at, left = [], [], []
        for wid, word in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            h = len(word) // 2
            for own, _, nodes in _paths(word):
                wids.append(wid)
                at.append(nodes[h])
                left.append(own[h:])
        yield pa.RecordBatch.from_arrays([pa.array(wids, pa.int64()), pa.array(at, pa.int64()), pa.array([0] * len(wids), pa.int32()), pa.array(left, pa.string())],
                                         [c.split()[0] for c in STATE.split(", ")])


def edge_table(words: DataFrame) -> DataFrame:
    """``node``, ``children`` (c, child, n words below, one of them, id of what follows in it, set of the letters next), of nodes with more than one word."""
    edges = words.select("wid", "word").mapInArrow(_edges, EDGE).groupBy("node", "c").agg(
        F.min("child").alias("child"), F.count("*").alias("n"), F.min("wid").alias("other"), F.min("tail").alias("tail"), F.bit_or("next").alias("next"))
    nodes = edges.groupBy("node").agg(F.sum("n").alias("below"), F.collect_list(F.struct("c", "child", "n", "other", "tail", "next")).alias("children"))
    return nodes.filter("below > 1").drop("below")


def _step(frontier: DataFrame, nodes: DataFrame) -> DataFrame:
    """States one level down, and with ``other`` set the neighbours reached; a state's position is where ``left`` begins.

    A state with its edit spent stays only if the letter it needs is among those next.
    """
    here, fresh = F.ascii("left"), F.col("edits") == 0
    useful = F.when(fresh, F.col("children")).otherwise(F.filter("children", lambda child: child["c"] == here))
    met = frontier.join(nodes, "node").select("wid", "edits", "left", F.inline(useful))
    ahead = F.substring("left", 2, 1 << 30)
    replaced = F.when((F.col("c") > here) & (here != 0), F.struct(F.lit(1).alias("edits"), ahead.alias("left")))
    inserted = F.when(F.col("c") != 0, F.struct(F.lit(1).alias("edits"), "left"))
    moves = F.when(F.col("c") == here, F.array(F.struct("edits", ahead.alias("left")))).otherwise(F.array_compact(F.array(replaced, inserted)))
    moved = met.select("wid", "child", "n", "other", "tail", "next", F.explode(moves).alias("to"))
    single = F.col("n") == 1
    arrived = single & (F.col("to.edits") == 1) & (F.col("tail") == F.xxhash64("to.left"))
    alive = ~single & ((F.col("to.edits") == 0) | (F.getbit("next", F.ascii("to.left") % BITS) == 1))
    return moved.filter(alive | arrived).select(
        "wid", F.col("child").alias("node"), F.col("to.edits").alias("edits"), F.when(~single, F.col("to.left")).alias("left"), F.when(single, F.col("other")).alias("other"))


def _unrolled(batches):
    """Of words still on their own path, the state at each further position, with ids of what follows instead of the word."""
    names, types = ["wid", "node", "here", "same", "after"], [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    for part in (p for batch in batches for p in slices(batch, 2, 1 << 18)):
        rows = []
        for wid, node, left in zip(*(c.to_pylist() for c in part.columns)):
            codes = [*map(ord, left), 0]
            nodes, tails = _chain(node, codes), [_tail(left[p:]) for p in range(len(left) + 2)]
            rows += [(wid, nodes[p], codes[p], tails[p], tails[p + 1]) for p in range(len(codes))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names)


def _looked_up(frontier: DataFrame, nodes: DataFrame, words: DataFrame) -> DataFrame:
    """(``wid``, ``other``) of the states left: an edge spends the edit, and node and id of the rest together find the word."""
    rows = frontier.filter("edits = 0").select("wid", "node", "left")
    rows = rows.mapInArrow(_unrolled, "wid long, node long, here int, same long, after long")
    met = rows.join(nodes, "node").select("wid", "here", "same", "after", F.inline("children")).filter("c <> here and c <> 0")
    wanted = F.array_compact(F.array("same", F.when((F.col("c") > F.col("here")) & (F.col("here") != 0), F.col("after"))))
    spent = met.select("wid", F.col("child").alias("node"), F.explode(wanted).alias("tail"))
    spent = spent.unionByName(frontier.filter("edits = 1").select("wid", "node", F.xxhash64("left").alias("tail")))
    tails = words.filter(F.length("word") > LEVELS).select("wid", "word").mapInArrow(_edges, EDGE)
    return spent.join(tails.select(F.col("child").alias("node"), "tail", F.col("wid").alias("other")), ["node", "tail"]).select("wid", "other")


def near_words(words: DataFrame) -> DataFrame:
    """(``word``, ``n``, ``near``, ``near_n``), both ways round, of words that differ by exactly one edit.

    ``words`` holds distinct ``wid``, ``word``, ``n``. A pair shares its first or
    its last half, so each word walks the trie of words and that of reversed
    words from the node of that half on. A state is (word, position, node, edits);
    each level joins the states with the edge table on the node, which has one row
    a node, so adaptive execution can split a hot node's states. The shorter word
    finds the longer one by an insertion, the lesser letter the greater by a
    replacement. A branch with one word left ends there: the id of what follows
    in it must be that of the rest, and a state whose edit is spent goes on only
    where the next letter can. Ids are hashes; equal ids of different strings only
    add candidates, and every pair is verified. Words rarely stay together for
    long; states alive after ``LEVELS`` levels end by one look-up of node and rest.
    """
    nodes = materialize(edge_table(words), "trie_nodes")
    frontier, found = words.select("wid", "word").mapInArrow(_seeds, STATE), []
    for _ in range(LEVELS):
        step = materialize(_step(frontier, nodes), "trie_states")
        found.append(step.filter("other is not null").select("wid", "other"))
        frontier = step.filter("other is null").drop("other")
        if frontier.isEmpty():
            break
    else:
        found.append(_looked_up(frontier, nodes, words))
    pairs = reduce(DataFrame.unionByName, found).distinct()
    named = words.select(F.col("wid").alias("other"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = pairs.join(words, "wid").join(named, "other").filter(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")
    pairs = materialize(pairs, "near_words")
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def _roots(forms: DataFrame) -> DataFrame:
    """(``word``, ``root``) by doubling: a form is twice as frequent, so chains are short."""
    roots = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        after = roots.select(F.col("word").alias("root"), F.col("root").alias("after"))
        more = materialize(roots.join(after, "root", "left").select("word", F.coalesce("after", "root").alias("root"), F.col("after").isNotNull().alias("moved")), "roots")
        roots = more.drop("moved")
        if more.filter("moved").isEmpty():
            return roots


def spelling_variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` for distinct (``word``, ``n``).

    The form is the near word of largest ``n`` (ties: the smallest word) if that
    is at least ``ratio`` times the word's own, else null; the root is the last
    of the chain of forms, the word itself without one. Null words are left out,
    other columns ignored; words of any length take part, an empty table gives no rows.
    """
    words = materialize(words.filter("word is not null").select(F.monotonically_increasing_id().alias("wid"), "word", "n"), "vocabulary")
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("_best"))
    formed = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("_best.near").alias("near"), (-F.col("_best.less")).alias("near_n"))
    wins = F.col("near_n") >= ratio * F.col("n")
    formed = materialize(formed.select("word", "n", "n_near", F.when(wins, F.col("near")).alias("form"), F.when(wins, F.col("near_n")).alias("form_n")), "forms")
    roots = _roots(formed.filter("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
