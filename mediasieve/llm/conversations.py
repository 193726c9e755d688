"""Repair the structure of conversations by divide and conquer over four-state cost vectors."""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

CHUNK = 4096                    # rows of one chunk of a conversation
NEVER = 1 << 50
TRIM = " \t\n\x0b\f\r"          # fixed: the white space of the contract
LEGAL = ("su", "ua", "au")      # fixed: role initials that may follow one another
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1      # fixed: costs of the contract
# states: nothing yet, after system, after user, after assistant; NEXT is the state after the turn that is due
NEXT, DUE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
KEEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
END = [0, 2 * INSERT, INSERT, 0]                    # cost to go after the last row
EDIT = "conv_id {id}, seq long, pos long, idx long, edit string, role string"


class Repair(NamedTuple):
    """``edits``: one row per kept, re-roled, deleted or inserted turn; ``summary``: one row per conversation."""

    edits: DataFrame
    summary: DataFrame


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` with planted faults, chosen by crc32 of ``conv_id:turn``; nulls as one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"),
                                (F.crc32(F.encode(F.concat(part("conv_id"), F.lit(":"), part("turn")), "utf-8")) % 20).alias("_kind"))
    kind, text = F.col("_kind"), F.col("text")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    rows = rows.filter(kind != 0).withColumns({"text": text, "role": F.when(kind == 4, "user").otherwise(F.col("role"))})
    return rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1)))).select("conv_id", "turn", "role", "text")


def _fault(text: Column) -> Column:
    bare = F.rtrim(text, F.lit(TRIM))
    return F.when(bare == "", "blank").when(F.col("repeated"), "duplicate").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated")


def faulty_rows(conversations: DataFrame) -> DataFrame:
    """Distinct turns with ``n`` (equal rows of one turn), ``digest`` and ``fault`` of the first of them; the others are duplicates."""
    some = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = conversations.select("conv_id", "turn", some("role").alias("role"), some("text").alias("text"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n")).withColumn("digest", F.sha2("text", 256))
    rows = materialize(rows, "turns")
    at = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn")
    first = rows.groupBy(*[F.col(c).alias(f"_{c}") for c in ("conv_id", "role", "digest")]).agg(F.min(at).alias("_at"))
    met = rows.join(first, F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest")))
    met = met.withColumn("repeated", at > F.col("_at"))
    return met.select("conv_id", "turn", "role", "text", "digest", "n", _fault(F.col("text")).alias("fault"))


def _numbered(chunk: int):
    """Adds the chunk (``seq`` grows along a conversation) and the row's place in it."""
    def run(batches):
        seq, idx, last = TaskContext.get().partitionId() << 40, 0, ()
        for batch in batches:
            seqs, places = [], []
            for conv in batch.column(0).to_pylist():
                if last != (conv,) or idx == chunk:
                    seq, idx, last = seq + 1, 0, (conv,)
                seqs.append(seq)
                places.append(idx)
                idx += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seqs, pa.int64()), pa.array(places, pa.int64())], [*batch.schema.names, "seq", "idx"])

    return run


def _moves(initial: str, fault: str | None) -> list[tuple[str, int, int, int]]:
    """(edit, state before, state after, cost) of a row, edits in ASCII order."""
    out = [("D", s, s, DELETE) for s in range(4)]
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        out += [("K", s, t, more) for s, t in KEEPS.get(initial, {}).items()] + [("R", s, NEXT[s], REROLE + more) for s in range(4)]
    return out


MOVES = {(i, f): _moves(i, f) for i in ("s", "u", "a", " ") for f in (None, "blank", "duplicate", "truncated")}


def _after_inserts(cost: list[int]) -> list[int]:
    user = min(cost[2], min(cost[0], cost[1], cost[3]) + INSERT)
    return [cost[0], cost[1], user, min(cost[3], user + INSERT)]


def forward(cost: list[int], rows) -> list[int]:
    """Least cost to be in each state after the rows; a row is (moves, further equal rows)."""
    for moves, copies in rows:
        cost, new = _after_inserts(cost), [NEVER] * 4
        for _, s, t, c in moves:
            if cost[s] + c < new[t]:
                new[t] = cost[s] + c
        cost = [c + DELETE * copies for c in new] if copies else new
    return cost


def backward(cost: list[int], rows) -> list[int]:
    """Least cost to go from each state before the rows, given that after them."""
    for moves, copies in reversed(rows):
        new = [NEVER] * 4
        for _, s, t, c in moves:
            if cost[t] + c + DELETE * copies < new[s]:
                new[s] = cost[t] + c + DELETE * copies
        user, assistant = min(new[2], new[3] + INSERT), min(new[3], new[2] + INSERT)
        cost = [min(new[0], user + INSERT), min(new[1], user + INSERT), user, assistant]
    return cost


def _one_row(row, state: int, after: list[int]) -> tuple[str, int]:
    moves, copies = row
    audit, go = "", backward(after, [row])
    while True:
        found = {e: (t, c + after[t] + DELETE * copies) for e, s, t, c in moves if s == state}
        found["I"] = (NEXT[state], INSERT + go[NEXT[state]])
        edit = min(e for e, (_, c) in found.items() if c == go[state])
        audit, state = audit + edit, found[edit][0]
        if edit != "I":
            return audit + "D" * copies, state


def least_audit(rows, state: int, after: list[int]) -> tuple[str, int]:
    """(the ASCII-least of the cheapest audits, the state it ends in) from ``state``, given the cost to go ``after``.

    The vectors forward from the start and backward from the end meet in the
    middle row; the states whose sum is least are the optimal crossings, and the
    first half, solved with those alone as its ends, takes the audit-least one.
    """
    if len(rows) == 1:
        return _one_row(rows[0], state, after)
    middle = len(rows) // 2
    left = forward([0 if s == state else NEVER for s in range(4)], rows[:middle])
    right = backward(after, rows[middle:])
    least = min(a + b for a, b in zip(left, right))
    first, state = least_audit(rows[:middle], state, [b if a + b == least else NEVER for a, b in zip(left, right)])
    second, state = least_audit(rows[middle:], state, after)
    return first + second, state


def _coded(rows) -> list:
    return [(MOVES[r["initial"] if r["initial"] in KEEPS else " ", r["fault"]], r["n"] - 1) for r in rows]


def _matrices(batches):
    """Costs from each state before a chunk to each state after it, and its illegal neighbours."""
    for batch in batches:
        costs, illegal, first, last = [], [], [], []
        for rows in batch.column(2).to_pylist():
            coded, said = _coded(rows), [r["initial"] for r in rows for _ in range(min(2, r["n"]))]
            costs.append([c for s in range(4) for c in forward([0 if s == t else NEVER for t in range(4)], coded)])
            # equal rows of a turn are neighbours of one initial, which is never legal
            illegal.append(sum(a + b not in LEGAL for a, b in zip(said, said[1:])) + sum(max(0, r["n"] - 2) for r in rows))
            first.append(said[0])
            last.append(said[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(costs, pa.list_(pa.int64())), pa.array(illegal, pa.int64()), pa.array(first), pa.array(last)],
                                         [*batch.schema.names, "costs", "illegal", "first", "last"])


def _met(batches):
    """Cost to go after each chunk; the conversation's cost and illegal neighbours with its first chunk."""
    for batch in batches:
        out = []
        for chunks in batch.column(0).to_pylist():
            after, cost = [], END
            for chunk in reversed(chunks):
                after.append(cost)
                cost = _entered([min(chunk["costs"][4 * s + t] + cost[t] for t in range(4)) for s in range(4)])
            bad = sum(c["illegal"] for c in chunks) + sum(a["last"] + b["first"] not in LEGAL for a, b in zip(chunks, chunks[1:]))
            for i, (chunk, go) in enumerate(zip(chunks, reversed(after))):
                out.append((chunk["seq"], i == 0, i == len(chunks) - 1, go, cost[0] if i == 0 else None, bad if i == 0 else None))
        types = [pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
        columns = zip(*out) if out else [[]] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["seq", "opens", "closes", "after", "cost", "illegal"])


def _entered(cost: list[int]) -> list[int]:
    """Never above what NEVER stands for, so sums of many chunks stay in range."""
    return [min(c, NEVER) for c in cost]


def _routes(batches):
    """The least audit of each chunk from each state it may start in, and where it ends."""
    for batch in batches:
        ends, audits = [], []
        for rows, opens, closes, after in zip(*(batch.column(c).to_pylist() for c in ("rows", "opens", "closes", "after"))):
            coded, own_ends, own = _coded(rows), [None] * 4, [None] * 4
            go = backward(after, coded)
            for s in [0] if opens else [s for s in range(4) if go[s] < NEVER]:
                audit, end = least_audit(coded, s, after)
                own_ends[s], own[s] = end, audit + "I" * (END[end] // INSERT if closes else 0)
            ends.append(own_ends)
            audits.append(own)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("seq"), batch.column("rows"), pa.array(ends, pa.list_(pa.int32())), pa.array(audits, pa.list_(pa.string()))],
                                         ["conv_id", "seq", "rows", "ends", "audits"])


def _chained(batches):
    """The state in which each chunk starts."""
    for batch in batches:
        seqs, starts = [], []
        for chunks in batch.column(0).to_pylist():
            state = 0
            for chunk in chunks:
                seqs.append(chunk["seq"])
                starts.append(state)
                state = chunk["ends"][state]
        yield pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64()), pa.array(starts, pa.int32())], ["seq", "start"])


def _edited(batches):
    """One row per edit but for deleted equal rows: which row it takes, and the role it gives."""
    for batch in batches:
        convs, out = [], []
        for conv, seq, rows, start, audit in zip(batch.column("conv_id"), *(batch.column(c).to_pylist() for c in ("seq", "rows", "start", "audit"))):
            state, at, pos = start, 0, 0
            while pos < len(audit):
                edit = audit[pos]
                convs.append(conv)
                out.append((seq, pos, None if edit == "I" else rows[at]["idx"], edit, DUE[state] if edit in "IR" else None))
                if edit == "K":
                    state = KEEPS[rows[at]["initial"]][state]
                elif edit != "D":
                    state = NEXT[state]
                pos += 1
                if edit != "I":
                    pos, at = pos + rows[at]["n"] - 1, at + 1
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = zip(*out) if out else [[]] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(convs, batch.column("conv_id").type), *[pa.array(c, t) for c, t in zip(columns, types)]],
                                         ["conv_id", "seq", "pos", "idx", "edit", "role"])


def repair(conversations: DataFrame, chunk: int = CHUNK) -> Repair:
    """Cheapest edits that make each conversation an optional system turn and pairs of user and assistant.

    ``conversations`` has ``conv_id``, ``turn``, ``role``, ``text``; other columns
    are ignored. A null role or text is one space, which is no role and blank; an
    empty role is no role either. Rows go by turn, null turns first, then by
    role and SHA-256 of the text, so rows that repeat stand together and reruns agree. A null ``conv_id`` is
    a conversation of its own. An empty table gives no rows.

    Equal rows of a turn are counted before they meet. Rows are ordered by ranges of
    (conversation, turn), so a long conversation spreads over partitions, and cut into chunks of
    ``chunk`` rows. A chunk is a 4 x 4 matrix of costs; the matrices of a
    conversation give the cost to go at each chunk's end, within which each chunk is solved
    for every state it may start in by ``least_audit``; the chain of ends picks
    one. One small row per chunk meets by conversation, never its turns.
    """
    spark, id_type = conversations.sparkSession, conversations.schema["conv_id"].dataType.simpleString()
    rows = materialize(faulty_rows(conversations), "faults")
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialize(ordered.mapInArrow(_numbered(chunk), f"{_fields(rows)}, seq long, idx long"), "ordered_turns")
    initial = F.when(F.col("role") == "", " ").otherwise(F.substring("role", 1, 1))
    parts = rows.groupBy("conv_id", "seq").agg(F.array_sort(F.collect_list(F.struct("idx", initial.alias("initial"), "fault", "n"))).alias("rows"))
    kind = "array<struct<idx:bigint,initial:string,fault:string,n:bigint>>"
    chunks = parts.mapInArrow(_matrices, f"conv_id {id_type}, seq long, rows {kind}, costs array<long>, illegal long, first string, last string")
    chunks = materialize(chunks, "chunks")
    lists = chunks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seq", "costs", "illegal", "first", "last"))).alias("chunks"))
    met = materialize(lists.select("chunks").mapInArrow(_met, "seq long, opens boolean, closes boolean, after array<long>, cost long, illegal long"), "met")
    routes = chunks.select("conv_id", "seq", "rows").join(met.drop("cost", "illegal"), "seq")
    routes = routes.select("conv_id", "seq", "rows", "opens", "closes", "after").mapInArrow(
        _routes, f"conv_id {id_type}, seq long, rows {kind}, ends array<int>, audits array<string>")
    routes = materialize(routes, "routes")
    ends = routes.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seq", "ends"))).alias("chunks"))
    starts = ends.select("chunks").mapInArrow(_chained, "seq long, start int")
    chosen = routes.join(starts, "seq").select("conv_id", "seq", "rows", "start", F.col("audits")[F.col("start")].alias("audit"))
    chosen = materialize(chosen, "audits")
    edits = chosen.mapInArrow(_edited, EDIT.format(id=id_type)).withColumnRenamed("role", "due")
    edits = edits.join(rows.select("seq", "idx", "turn", "role", "text"), ["seq", "idx"], "left").select(
        "conv_id", "seq", "pos", "edit", "turn", F.coalesce("due", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return Repair(edits, _summary(rows, chunks, met, chosen))


def _fields(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def _summary(rows: DataFrame, chunks: DataFrame, met: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row per conversation; each part is aggregated before they meet, so null ids group like others."""
    times = lambda fault: F.sum(F.when(F.col("fault") == fault, 1).otherwise(0))
    copies = F.sum(F.when(F.coalesce("fault", F.lit("")) == "blank", 0).otherwise(F.col("n") - 1))
    blank = F.sum(F.when(F.col("fault") == "blank", F.col("n")).otherwise(0))
    faults = rows.groupBy("conv_id").agg(blank.alias("blank"), (times("duplicate") + copies).alias("duplicate"), times("truncated").alias("truncated"))
    turns = rows.filter("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("one"))
    gaps = turns.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    costs = chunks.select("conv_id", "seq").join(met.filter("opens").select("seq", "cost", "illegal"), "seq").drop("seq")
    audits = chosen.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    both = faults.unionByName(gaps, True).unionByName(costs, True).unionByName(audits, True)
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return both.groupBy("conv_id").agg(*[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in names], F.coalesce(F.max("audit"), F.lit("")).alias("audit"))


def _hashed(batches):
    """SHA-256 of each conversation's lines as they stream by in order."""
    import hashlib

    state, last = None, ()
    for batch in batches:
        convs, sums = [], []
        for conv, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if last != (conv,):
                if state:
                    convs.append(last[0])
                    sums.append(state.hexdigest())
                state, last = hashlib.sha256(), (conv,)
            else:
                state.update(b"\n")
            state.update(line.encode())
        yield pa.RecordBatch.from_arrays([pa.array(convs, batch.column(0).type), pa.array(sums, pa.string())], ["conv_id", "repaired_sha256"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([last[0]], batch.column(0).type), pa.array([state.hexdigest()])], ["conv_id", "repaired_sha256"])


def repaired_digests(edits: DataFrame) -> DataFrame:
    """``conv_id``, ``repaired_sha256`` of the turns that stay as ``role:text`` lines; no turn is held longer than it streams by."""
    id_type = edits.schema["conv_id"].dataType.simpleString()
    lines = edits.filter("edit <> 'D'").select("conv_id", F.concat("role", F.lit(":"), "text").alias("line"), "seq", "pos")
    lines = lines.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "pos").select("conv_id", "line")
    return lines.mapInArrow(_hashed, f"conv_id {id_type}, repaired_sha256 string")


def summary_with_digests(conversations: DataFrame, repaired: Repair) -> DataFrame:
    """The summary of every ``conv_id`` of ``conversations``, also of those without a row left, and the digest of what was repaired."""
    every = conversations.select("conv_id").distinct()
    both = every.unionByName(repaired.summary, True).unionByName(repaired_digests(repaired.edits), True)
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return both.groupBy("conv_id").agg(*[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in names], F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
                                       F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
