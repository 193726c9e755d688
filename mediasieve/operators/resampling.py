"""Bootstrap replicates as lanes: however many there are, the rows are ordered once."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import shared_folder, stored
from ..sources.in_place import opened

LANES = 128                 # replicates of one row of partial sums
PER_DIGEST = 8              # weights of one SHA-256 digest
PIECE = 1_500_000           # rows a task orders and weighs at once
DRAWN = 65_536              # ids whose digests are held at once
NUMBERED_IN = 4096          # parts in which ids are numbered
WORDS = 128 << 20           # bytes of weights a task holds at once, eight for two digests of an id; two digests of every id at least
MOST_WORDS = 4              # words of one id: 64 lanes
BLOCK_ROWS = 256            # most rows of a block, whose pairs are counted by halves
STACKED = 8_192             # rows of blocks counted at once
NOT_A_NUMBER = 1.7976931348623157e308       # stands for NaN among scores: equal to itself, above all others


def lane_weights(row_id: str | None, replicates: int, seed: int, bounds: np.ndarray) -> np.ndarray:
    """Poisson(1) weights of an id in all replicates, eight per digest of (seed, block, id); without an id none."""
    if row_id is None:
        return np.zeros(replicates)
    blocks = [block_weights([row_id.encode()], block, seed, bounds)[0] for block in range(-(-replicates // PER_DIGEST))]
    return np.concatenate(blocks)[:replicates].astype(np.float64)


def block_weights(ids: list[bytes], block: int, seed: int, bounds) -> np.ndarray:
    """The eight weights of one block for many ids, a row of bytes per id."""
    prefix, sha = f"{seed}:{block}:".encode(), hashlib.sha256
    weights = np.zeros((len(ids), PER_DIGEST), np.uint8)
    # drawn / 2^32 >= bound, in whole numbers
    limits = np.ceil(np.asarray(bounds) * 2.0 ** 32).astype(np.uint32)
    for at in range(0, len(ids), DRAWN):
        drawn = np.frombuffer(b"".join([sha(prefix + i).digest() for i in ids[at:at + DRAWN]]), ">u4").reshape(-1, PER_DIGEST).astype(np.uint32)
        for limit in limits:
            weights[at:at + DRAWN] += drawn >= limit
    return weights


def _coded(column) -> tuple[np.ndarray, pa.Array]:
    """Codes of a column's values, NULL among them, and the values."""
    coded = column.combine_chunks().dictionary_encode(null_encoding="encode")
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def _encoded_ids(values: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """Distinct ids as bytes, and which of them are not NULL."""
    return [b"" if v is None else v for v in values.cast(pa.binary()).to_pylist()], values.is_valid().to_numpy(zero_copy_only=False)


def _group_codes(table: pa.Table, by: list[str]) -> np.ndarray:
    """One number per row and group, in no special order."""
    codes = np.zeros(table.num_rows, np.int64)
    for name in by:
        own, values = _coded(table[name])
        # renumbered at every column, so the numbers stay below the number of rows
        codes = np.unique(codes * max(len(values), 1) + own, return_inverse=True)[1]
    return codes


def _pieces(batches, rows: int):
    """Arrow batches as tables of about that many rows."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


def _ordered(table: pa.Table, by: list[str]) -> tuple:
    """A piece by group: the order, where runs of one score and groups begin, and the score of a run."""
    codes = _group_codes(table, by)
    order = np.argsort(codes, kind="stable")
    codes, key = codes[order], table["_key"].combine_chunks()
    null = key.is_null().to_numpy(zero_copy_only=False)[order]
    score = key.fill_null(0.0).to_numpy(zero_copy_only=False)[order]
    score = np.where(np.isnan(score), NOT_A_NUMBER, score)
    first = np.ones(len(codes), bool)
    first[1:] = codes[1:] != codes[:-1]
    opens = first.copy()
    opens[1:] |= (score[1:] != score[:-1]) | (null[1:] != null[:-1])
    runs = np.flatnonzero(opens)
    return order, runs, np.flatnonzero(first[runs]), lambda run: None if null[runs[run]] else float(score[runs[run]])


def _lane_sums(weight, positive, known, runs, groups, middle, belongs):
    """One replicate of a piece: sums per run of either class, and per group those of its middle runs with pairs won less lost."""
    pos = np.add.reduceat(np.where(positive, weight, 0), runs, dtype=np.int64)
    neg = np.add.reduceat(np.where(known & ~positive, weight, 0), runs, dtype=np.int64)
    p, n = pos * middle, neg * middle
    p_before, n_before = np.cumsum(p) - p, np.cumsum(n) - n
    won = p * (n_before - n_before[groups][belongs]) - n * (p_before - p_before[groups][belongs])
    return pos, neg, np.add.reduceat(p, groups), np.add.reduceat(n, groups), np.add.reduceat(won, groups)


def _partial(by: list[str], replicates: int, seed: int, bounds: tuple[float, ...], piece: int):
    names = [*by, "_chunk", "_lane", "_part", "_score", "_pos", "_neg", "_won"]

    def run(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for table in _pieces(batches, piece):
            yield from summed(table, chunk)
            chunk += 1

    def summed(table: pa.Table, chunk: int):
        order, runs, groups, score_of = _ordered(table, by)
        own, values = _coded(table["_id"])
        own, (ids, present) = own[order], _encoded_ids(values)
        label = table["_positive"].combine_chunks()
        known = label.is_valid().to_numpy(zero_copy_only=False)[order]
        positive = label.fill_null(False).to_numpy(zero_copy_only=False)[order]
        head = table.select(by).take(order[runs[groups]])
        last = np.append(groups[1:], len(runs)) - 1
        middle = np.ones(len(runs), np.int64)
        middle[groups] = middle[last] = 0
        belongs = np.repeat(np.arange(len(groups)), np.diff(np.append(groups, len(runs))))
        # a group's first run, its middle and its last; a single run is the first
        parts = [(0, np.arange(len(groups))), (1, np.flatnonzero(last > groups)), (2, np.flatnonzero(last > groups))]
        for at in range(0, replicates, LANES):
            width = min(LANES, replicates - at)
            sums = np.zeros((3, 3, len(groups), width))         # part; positives, negatives, won
            for lane in range(0, width, PER_DIGEST):
                weights = block_weights(ids, (at + lane) // PER_DIGEST, seed, bounds)
                weights[~present] = 0
                for i in range(min(PER_DIGEST, width - lane)):
                    pos, neg, p, n, won = _lane_sums(weights[own, i], positive, known, runs, groups, middle, belongs)
                    sums[0, :2, :, lane + i] = pos[groups], neg[groups]
                    sums[1, :, :, lane + i] = p, n, won
                    sums[2, :2, :, lane + i] = pos[last], neg[last]
            for part, which in parts:
                if not len(which):
                    continue
                ends = groups if part == 0 else last
                count = len(which)
                fixed = [pa.array([chunk] * count, pa.int64()), pa.array([at] * count, pa.int32()), pa.array([part] * count, pa.int32()),
                         pa.array([None if part == 1 else score_of(ends[g]) for g in which], pa.float64())]
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, (count + 1) * width, width), pa.int32()), pa.array(side[which].ravel()))
                         for side in sums[part]]
                columns = [head.column(i).take(which).combine_chunks() for i in range(len(by))]
                yield from pa.Table.from_arrays([*columns, *fixed, *lists], names).to_batches()

    return run


def _auroc_of(parts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """AUROC of each lane from (score, part, positives, negatives, won) in order, and where it is defined; equal scores of neighbouring parts are one."""
    pos, neg, won = np.zeros(width), np.zeros(width), np.zeros(width)
    tie = None

    def flushed():
        nonlocal pos, neg, won
        if tie:
            won = won + tie[1] * neg - tie[2] * pos
            pos, neg = pos + tie[1], neg + tie[2]

    for score, part, p, n, inside in parts:
        if part != 1 and tie and tie[0] == score:
            tie = (tie[0], tie[1] + p, tie[2] + n)
        elif part != 1:
            flushed()
            tie = (score, p, n)
        elif p.any() or n.any():
            flushed()
            tie = None
            won = won + inside + p * neg - n * pos
            pos, neg = pos + p, neg + n
    flushed()
    both = (pos > 0) & (neg > 0)
    return 0.5 + won / np.where(both, 2 * pos * neg, 1), both


def _met(by: list[str]):
    """AUROC of each lane from the parts of a group."""
    def run(key, table):
        lane = key[-1].as_py()
        rows = sorted(table.select(["_chunk", "_part", "_score", "_pos", "_neg", "_won"]).to_pylist(), key=lambda r: (r["_chunk"], r["_part"]))
        width = len(rows[0]["_pos"])
        value, both = _auroc_of([(r["_score"], r["_part"], np.array(r["_pos"]), np.array(r["_neg"]), np.array(r["_won"])) for r in rows], width)
        arrays = [pa.array([k.as_py()] * width, k.type) for k in key[:-1]]
        return pa.Table.from_arrays([*arrays, pa.array(np.arange(lane, lane + width)), pa.array(value, pa.float64(), mask=~both)], [*by, "replicate", "auroc"])

    return run


# ── ids in many groups ──────────────────────────────────────────────────────

@dataclass
class Ids:
    """Distinct ids of a frame, written once: files of (``_code``, ``_id``), and where the numbers of each part begin."""

    files: list[str]
    begins: np.ndarray
    total: int

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        """Numbers from 1 without large gaps; 0 stands for no id."""
        return self.begins[codes >> 32] + (codes & 0xFFFFFFFF)


def deal(row_id) -> Column:
    """The part in which an id is numbered."""
    return F.pmod(F.xxhash64(F.xxhash64(row_id.cast("string"))), F.lit(NUMBERED_IN))


def number_ids(df: DataFrame, id_col: str, only: Column | None = None, dealt: str | None = None) -> tuple[DataFrame, Ids]:
    """The frame written once with ``_code``, the number of its id in its part (NULL without an id), and the distinct ids.

    With ``only`` the ids of other rows get no number. A frame that lies by :func:`deal` already names that column as ``dealt``.
    """
    key, only = F.col("_id"), F.lit(True) if only is None else F.coalesce(only, F.lit(False))
    names = [name for name in df.columns if name != dealt]
    # rows without an id lie anywhere
    part = F.col(dealt) if dealt else F.when(F.col(id_col).isNull(), F.pmod(F.xxhash64(*names), F.lit(NUMBERED_IN))).otherwise(deal(F.col(id_col)))
    rows = df.withColumn("_id", F.col(id_col).cast("string")).withColumn("_deal", part).withColumn("_only", only & key.isNotNull())
    own = Window.partitionBy("_deal", "_only").orderBy("_id")
    code = F.when(F.col("_only"), F.col("_deal") * F.lit(1 << 32) + F.dense_rank().over(own))
    opens = F.when(F.col("_only") & ~key.eqNullSafe(F.lag("_id").over(own)), key)
    rows = stored(rows.select(*names, code.alias("_code"), opens.alias("_id")), "numbered")
    ids = stored(rows.where("_id IS NOT NULL").select("_code", "_id"), "ids")
    most = ids.groupBy(F.shiftright("_code", 32).alias("part")).agg(F.max(F.col("_code").bitwiseAND(0xFFFFFFFF)).alias("most")).collect()   # a row per part
    sizes = np.zeros(NUMBERED_IN, np.int64)
    for row in most:
        sizes[row["part"]] = row["most"]
    return rows.drop("_id"), Ids(ids.inputFiles(), np.cumsum(sizes) - sizes, int(sizes.sum()))


def _halved(height: int) -> np.ndarray:
    """The row of a block that lies at each place, so that neighbours lie half a block apart."""
    rows = np.zeros(1, np.int64)
    while len(rows) < height:
        rows = np.concatenate([2 * rows, 2 * rows + 1])
    return rows


def _blocks_of(starts: np.ndarray, ends: np.ndarray, height: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of each stretch of rows, and the place of every row when each stretch begins a new block."""
    blocks = -(-(ends - starts) // height)
    at = (np.cumsum(blocks) - blocks) * height
    return blocks, np.repeat(at - starts, ends - starts) + np.arange(starts[0], ends[-1])


def _packs(by: list[str], ids: Ids, kind: str):
    """A range of rows as one row: the id numbers and classes of its groups' stretches, ordered by score and laid in blocks."""
    def run(batches):
        from pyspark import TaskContext

        held = list(batches)
        if not sum(batch.num_rows for batch in held):
            return
        table = pa.Table.from_batches(held)
        code, key, label = (table[name].combine_chunks() for name in ("_code", "_key", "_positive"))
        counted = code.is_valid().to_numpy(zero_copy_only=False) & label.is_valid().to_numpy(zero_copy_only=False)
        positive = label.fill_null(False).to_numpy(zero_copy_only=False)
        entry = (np.where(counted, ids.numbers(code.fill_null(0).to_numpy(zero_copy_only=False)), 0) * 2 + positive).astype(kind)
        known = key.is_valid().to_numpy(zero_copy_only=False)
        score = key.fill_null(0.0).to_numpy(zero_copy_only=False)
        score = np.where(np.isnan(score), NOT_A_NUMBER, score)
        group = _group_codes(table, by)
        # among equal scores positives come first: a pair is won by a positive behind a negative
        order = np.lexsort((~positive, score, known, group))
        by_group, by_score, by_known = group[order], score[order], known[order]
        first = np.ones(len(order), bool)
        first[1:] = by_group[1:] != by_group[:-1]
        opens = first.copy()
        opens[1:] |= (by_score[1:] != by_score[:-1]) | (by_known[1:] != by_known[:-1])
        runs = np.append(np.flatnonzero(opens), len(order))
        groups = np.flatnonzero(first[runs[:-1]])
        last = np.append(groups[1:], len(runs) - 1) - 1
        # a group's first run, its middle and its last; a single run is the first
        parts = [(runs[g], runs[g + 1], 0) for g in groups] + [(runs[g + 1], runs[z], 1) for g, z in zip(groups, last) if z > g + 1] \
            + [(runs[z], runs[z + 1], 2) for g, z in zip(groups, last) if z > g]
        starts, ends, part = (np.array(column, np.int64) for column in zip(*sorted(parts)))
        height = 1 << int(np.clip(np.log2(len(order) / len(starts)), 3, np.log2(BLOCK_ROWS)))
        blocks, place = _blocks_of(starts, ends, height)

        def laid(order):
            flat = np.zeros(int(blocks.sum()) * height, kind)
            flat[place] = entry[order]
            return np.ascontiguousarray(flat.reshape(-1, height)[:, _halved(height)].T).tobytes()

        both = np.add.reduceat((positive & counted)[order], runs[:-1], dtype=np.int64) * np.add.reduceat((~positive & counted)[order], runs[:-1], dtype=np.int64)
        again = laid(np.lexsort((positive, score, known, group))) if both.any() else None
        whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        head = table.select(by).take(order[starts])
        yield pa.RecordBatch.from_arrays(
            [*[whole(head.column(i).combine_chunks()) for i in range(len(by))], pa.array([TaskContext.get().partitionId()], pa.int32()),
             whole(pa.array(part, pa.int32())), whole(pa.array(np.where(by_known[starts] & (part != 1), by_score[starts], 0), mask=~by_known[starts] | (part == 1))),
             whole(pa.array(blocks, pa.int32())), pa.array([height], pa.int32()), pa.array([laid(order)], pa.binary()), pa.array([again], pa.binary())],
            [*by, "_chunk", "_parts", "_scores", "_blocks", "_height", "_rows", "_again"])

    return run


class _Halves:
    """Pairs of a positive behind a negative in blocks of packed rows, in the lanes of ``words`` (two digests a word, four bits a weight).

    Row 2i + 1 of a block lies half a block behind row 2i, and so on for the halves: the pairs of two neighbours are the right one's positives
    times the left one's negatives, and both become one row. Every array is made once, in the smallest kind that holds its sums.
    """

    def __init__(self, height: int, words: np.ndarray, most: int):
        blocks, width = max(1, STACKED // height), words.shape[1]
        self.words, self.shape = words, (height, blocks, width)
        self.entries, self.at, self.sign = np.zeros((height, blocks), np.int64), np.empty((height, blocks), np.intp), np.empty((height, blocks), np.uint64)
        self.weight, self.mask, pos, neg = (np.empty(self.shape, np.uint64) for _ in range(4))
        self.steps = [(np.bitwise_and, (self.weight, np.uint64(0x0F0F0F0F0F0F0F0F), neg)), (np.bitwise_and, (neg, self.mask, pos)), (np.bitwise_xor, (neg, pos, neg))]
        pos, neg = pos.view(np.uint8).reshape(height, -1), neg.view(np.uint8).reshape(height, -1)
        wins, size = None, 1

        def widened(side, kind):
            wide = np.empty(side.shape, kind)
            self.steps.append((np.copyto, (wide, side)))
            return wide

        while len(pos) > 1:
            size, half = 2 * size, len(pos) // 2
            kind = np.min_scalar_type((most * size) ** 2 // 4)
            if pos.dtype != kind:
                pos, neg, wins = widened(pos, kind), widened(neg, kind), None if wins is None else widened(wins, kind)
            pairs = np.empty((half, pos.shape[1]), kind)
            self.steps.append((np.multiply, (pos[half:], neg[:half], pairs)))
            if wins is not None:
                self.steps += [(np.add, (pairs, wins[:half], pairs)), (np.add, (pairs, wins[half:], pairs))]
            self.steps += [(np.add, (side[:half], side[half:], side[:half])) for side in (pos, neg)]
            pos, neg, wins = pos[:half], neg[:half], pairs
        self.found = (pos, neg, wins)

    def sums(self, entries: np.ndarray) -> list[np.ndarray]:
        """(positives, negatives, wins) of every block, a row of lanes each."""
        _, blocks, width = self.shape
        count = entries.shape[1]
        self.entries[:, :count], self.entries[:, count:] = entries, 0
        np.right_shift(self.entries, 1, out=self.at)
        np.take(self.words, self.at, axis=0, out=self.weight, mode="clip")
        np.bitwise_and(self.entries, 1, out=self.sign, casting="unsafe")
        np.negative(self.sign, out=self.sign)
        self.mask[...] = self.sign[..., None]
        sides = []
        for digest in range(2):
            if digest:
                np.right_shift(self.weight, np.uint64(4), out=self.weight)
            for step, arrays in self.steps:
                step(*arrays)
            sides.append([side.reshape(blocks, width, 1, PER_DIGEST).astype(np.int64) for side in self.found])
        return [np.concatenate(side, axis=2).reshape(blocks, -1)[:count] for side in zip(*sides)]


def _stretch_sums(rows: np.ndarray, blocks: np.ndarray, halves: _Halves) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of every stretch of blocks."""
    step = halves.shape[1]
    pos, neg, wins = (np.concatenate(side) for side in zip(*[halves.sums(rows[:, at:at + step]) for at in range(0, rows.shape[1], step)]))
    begins = np.cumsum(blocks) - blocks
    before = np.cumsum(neg, axis=0) - neg
    wins = wins + pos * (before - np.repeat(before[begins], blocks, axis=0))
    return tuple(np.add.reduceat(side, begins, axis=0) for side in (pos, neg, wins))


def _lanes(by: list[str], types: list, files: list[str], ids: Ids, kind: str, replicates: int, seed: int, bounds: tuple[float, ...], each: int):
    """AUROC of every group in the replicates of a few digests: each id is weighed once, then all packed rows pass by."""
    names = [*by, "replicate", "auroc"]

    def rows_of(path):
        with opened(path) as file:
            for batch in pq.ParquetFile(file).iter_batches(1):
                yield batch.to_pylist()[0]

    def weighed(digests):
        words = np.zeros((ids.total + 1, -(-len(digests) // 2)), np.uint64)
        for path in ids.files:
            with opened(path) as file:
                for batch in pq.ParquetFile(file).iter_batches(DRAWN, columns=["_code", "_id"]):
                    numbers, texts = ids.numbers(batch.column(0).to_numpy()), batch.column(1).cast(pa.binary()).to_pylist()
                    for i, digest in enumerate(digests):
                        words[numbers, i // 2] |= block_weights(texts, digest, seed, bounds).view(np.uint64)[:, 0] << np.uint64(4 * (i % 2))
        return words

    def run(batches):
        for batch in batches:
            for first in batch.column(0).to_pylist():
                yield from found(range(first, min(first + each, -(-replicates // PER_DIGEST))))

    def found(digests):
        words, groups, halves = weighed(digests), {}, {}
        for path in files:
            for row in rows_of(path):
                size = np.array(row["_blocks"])
                orders = [np.frombuffer(data, kind).reshape(row["_height"], -1) for data in (row["_rows"], row["_again"]) if data]
                if row["_height"] not in halves:
                    halves[row["_height"]] = _Halves(row["_height"], words, len(bounds))
                (pos, neg, wins), *again = [_stretch_sums(rows, size, halves[row["_height"]]) for rows in orders]
                # ties are won in one order and lost in the other
                pos, neg, won = (side.astype(float) for side in (pos, neg, wins + (again[0][2] if again else wins) - pos * neg))
                for i, (part, score) in enumerate(zip(row["_parts"], row["_scores"])):
                    name = [row[column][i] for column in by]
                    # a missing or undefined name equals itself
                    own = groups.setdefault(tuple("nan" if x != x else (x,) for x in name), (name, []))
                    own[1].append((row["_chunk"], part, score, pos[i], neg[i], won[i]))
        lanes = np.arange(digests[0] * PER_DIGEST, min((digests[-1] + 1) * PER_DIGEST, replicates))
        for name, parts in groups.values():
            parts.sort(key=lambda own: own[:2])
            value, both = _auroc_of([(score, part, *sums) for _, part, score, *sums in parts], 2 * PER_DIGEST * words.shape[1])
            width = len(lanes)
            yield pa.RecordBatch.from_arrays([*[pa.array([x] * width, t) for x, t in zip(name, types)], pa.array(lanes), pa.array(value[:width], mask=~both[:width])], names)

    return run


def readable(spark: SparkSession) -> bool:
    """Whether Arrow knows the file system of the shared folder."""
    path = shared_folder(spark)
    try:
        return not (":/" in path and fs.FileSystem.from_uri(path) is None)
    except (pa.ArrowException, OSError, ValueError):
        return False


def _shared_auroc(df: DataFrame, by: list[str], score: str, label: str, id_col: str, replicates: int, seed: int, bounds: tuple[float, ...],
                  piece: int, ids: Ids | None) -> DataFrame:
    """Ids in many groups: numbered once, rows packed by range of (group, score), and a task for every few digests that weighs each id once.

    A row is some four bytes when packed, so that each of these tasks can read all of them. A range holds about half of
    ``piece`` rows, as it is ordered at once.
    """
    spark = df.sparkSession
    if ids is None:
        df, ids = number_ids(df.select(*{*by, score, label, id_col}), id_col)
    kind = "u4" if ids.total < (1 << 31) - 1 else "u8"
    cores = spark.sparkContext.defaultParallelism
    rows = df.select(*by, F.col(score).cast("double").alias("_key"), "_code", (F.col(label) == 1).alias("_positive"))
    ranges = max(2 * cores, -(-rows.count() // max(1, piece // 2)))
    fields = [(f"`{f.name}`", f.dataType) for f in rows.select(*by).schema]
    packed = stored(rows.repartitionByRange(ranges, *by, "_key", "_code").mapInArrow(
        _packs(by, ids, kind), "".join(f"{name} array<{t.simpleString()}>, " for name, t in fields)
        + "_chunk int, _parts array<int>, _scores array<double>, _blocks array<int>, _height int, _rows binary, _again binary"), "packed")
    digests = -(-replicates // PER_DIGEST)
    each = 2 * max(1, min(MOST_WORDS, -(-digests // (4 * cores)), WORDS // (8 * (ids.total + 1))))
    starts = spark.range(0, digests, each, -(-digests // each))
    run = _lanes(by, [to_arrow_type(t) for _, t in fields], packed.inputFiles(), ids, kind, replicates, seed, bounds, each)
    return stored(starts.mapInArrow(run, "".join(f"{name} {t.simpleString()}, " for name, t in fields) + "replicate long, auroc double"), "replicates")


def replicate_auroc(df: DataFrame, by: list[str], score: str, label: str, id_col: str, replicates: int, seed: int, bounds: tuple[float, ...],
                    shared_ids: bool = False, piece: int = PIECE, ids: Ids | None = None) -> DataFrame:
    """(``by``, ``replicate``, ``auroc``) under Poisson weights that depend on the id alone.

    Rows are cut into ranges of (group, score, id) once, so a score that very many rows
    share spreads over ranges too. A task takes its range in pieces of at most about ``piece`` rows; a piece reduces to three
    rows of lane sums a group and block of ``LANES``, which is all that meets by group. With ``shared_ids`` (few groups, ids in
    many of them) each id is weighed once in all (:func:`_shared_auroc`), where Arrow can read the shared folder; elsewhere ranges
    are of (score, id), so that groups meet in them and an id is weighed once a piece. ``ids`` are those of a
    frame that :func:`number_ids` wrote. A NULL score is below all others, a NULL
    label takes no part, a group without both classes has a NULL AUROC.
    """
    if shared_ids and (ids is not None or len(bounds) < 16 and readable(df.sparkSession)):
        return _shared_auroc(df, by, score, label, id_col, replicates, seed, bounds, piece, ids)
    key = F.col(score).cast("double")
    rows = df.select(*by, key.alias("_key"), F.col(id_col).cast("string").alias("_id"), (F.col(label) == 1).alias("_positive"))
    # a row is a few bytes but all its replicates' work: the number of ranges is not left to their bytes
    spark = df.sparkSession
    parts = 2 * spark.sparkContext.defaultParallelism if shared_ids else int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["_key", "_id", *by] if shared_ids else [*by, "_key", "_id"]
    # ranges are bound to one evaluation: their numbers and sums come from the same stage
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*by).schema)
    sums = rows.mapInArrow(_partial(by, replicates, seed, bounds, piece),
                           f"{fields}_chunk long, _lane int, _part int, _score double, _pos array<double>, _neg array<double>, _won array<double>")
    return sums.groupBy(*by, "_lane").applyInArrow(lambda key, table: _met(by)(key, table), f"{fields}replicate long, auroc double")


def weight_rows(df: DataFrame, id_col: str, replicates: int, seed: int, bounds: tuple[float, ...]) -> DataFrame:
    """Every row once per block of eight replicates, with ``block`` and ``w0..w7``; without an id the weights are NULL."""
    names = list(df.columns)
    lanes = [f"w{i}" for i in range(PER_DIGEST)]

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            own, values = _coded(table["_id"])
            ids, present = _encoded_ids(values)
            for block in range(-(-replicates // PER_DIGEST)):
                weights = block_weights(ids, block, seed, bounds)[own].astype(np.int32)
                columns = [pa.array(weights[:, i], mask=~present[own]) for i in range(PER_DIGEST)]
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], pa.array(np.full(len(own), block, np.int32)), *columns], [*names, "block", *lanes])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema)
    rows = df.withColumn("_id", F.col(id_col).cast("string"))
    return rows.mapInArrow(run, f"{fields}block int, {', '.join(f'{w} int' for w in lanes)}")


def weight_sums(df: DataFrame, by: list[str], id_col: str, replicates: int, seed: int, bounds: tuple[float, ...]) -> DataFrame:
    """(``by``, ``block``, ``w0..w7``): the weights of a group's ids summed, per task before they meet by group and block."""
    blocks, lanes = -(-replicates // PER_DIGEST), [f"w{i}" for i in range(PER_DIGEST)]

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            codes = _group_codes(table, by)
            order = np.argsort(codes, kind="stable")
            groups = np.flatnonzero(np.diff(codes[order], prepend=-1))
            own, values = _coded(table["_id"])
            own, (ids, present) = own[order], _encoded_ids(values)
            head = table.select(by).take(order[groups])
            unknown = np.add.reduceat(present[own], groups, dtype=np.int64) == 0
            for block in range(blocks):
                weights = block_weights(ids, block, seed, bounds)
                weights[~present] = 0
                # eight bytes are one number to gather
                sums = np.add.reduceat(weights.view(np.uint64)[:, 0][own].view(np.uint8).reshape(-1, PER_DIGEST).T, groups, axis=1, dtype=np.int64)
                yield from pa.Table.from_arrays([*[head.column(i).combine_chunks() for i in range(len(by))], pa.array(np.full(len(groups), block, np.int32)),
                                                 *[pa.array(lane, mask=unknown) for lane in sums]], [*by, "block", *lanes]).to_batches()

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*by).schema)
    rows = df.select(*by, F.col(id_col).cast("string").alias("_id"))
    parts = rows.mapInArrow(run, f"{fields}block int, {', '.join(f'{w} long' for w in lanes)}")
    return parts.groupBy(*by, "block").agg(*[F.sum(w).alias(w) for w in lanes])
