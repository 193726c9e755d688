"""Spelling variants, conversation repair and line dedup against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm import awkward, empty, pairs, same

from mediasieve.llm import conversations, lines, queries, spelling

WHITE = " \t\n\v\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VARIANTS = ["word", "form", "root", "n", "n_near", "form_n"]
REPAIRED = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


# -- spelling ---------------------------------------------------------------------------------------------------------

def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    first = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and len(b) - len(a) < 2 and b[first + 1:] == a[first + (len(a) == len(b)):]


def near(n):
    """Near words of each word: the same with one place left open, or one the other without a letter."""
    open_, out = defaultdict(set), {w: set() for w in n}
    short, long = [w for w in n if len(w) < 100], [w for w in n if len(w) >= 99]
    for w in short:
        for i in range(len(w)):
            open_[w[:i], w[i + 1:]].add(w)
    for w in short:
        for i in range(len(w)):
            out[w] |= open_[w[:i], w[i + 1:]] - {w}
        for shorter in {w[:i] + w[i + 1:] for i in range(len(w))} & out.keys():
            out[w].add(shorter)
            out[shorter].add(w)
    for w in long:
        out[w] |= {o for o in long if one_edit(w, o)}
    return out


def brute_counts(rows, every):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def brute_variants(n):
    found, form = near(n), {}
    for w in n:
        best = min(found[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(found[w]), n.get(form[w])))
    return out


def test_spelling_query_is_brute_force(spark):
    rows = pairs(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    same(queries.op11_spelling(spark, "/root/testdata/sf0.01"), brute_variants(brute_counts(rows, 97)), VARIANTS)


def test_spelling_of_awkward_rows(spark):
    more = ["Straße straße STRASSE çédille ÇÉDILLE çedille", "abcde abcdf abcdef abcd xabcde aabcde abcdee abcdde " * 3, "ab×cd÷ef " * 4, "a" * 60_000, "a" * 59_999, "ab" * 9_000 + "c" + "ab" * 3_000, "ab" * 12_000]
    df = awkward(spark, 3 * more)
    for every in (0, 3):
        n = brute_counts(pairs(df), every)
        same(spelling.spelling_variants(spelling.count_words(df, damage_every=every)), brute_variants(n), VARIANTS)
    for none in (empty(spark), df.limit(0), df.withColumn("text", F.lit(None).cast("string"))):
        same(spelling.spelling_variants(spelling.count_words(none)), [], VARIANTS)


@pytest.mark.parametrize("letters, longest", [("ab", 9), ("abcé", 7), ("a", 40)])
def test_spelling_of_dense_words(spark, letters, longest):
    """Words over few letters: all nodes are shared, ties are many, chains of forms are long."""
    draw = random.Random(11)
    words = {"".join(draw.choice(letters) for _ in range(draw.randint(5, longest))) for _ in range(300)}
    n = {w: 3 * 2 ** draw.randint(0, 9) for w in words}
    table = spark.createDataFrame([(w, k, "clash", 1) for w, k in n.items()] + [(None, 5, "", 2)], "word string, n long, near string, wid long")
    same(spelling.spelling_variants(table), brute_variants(n), VARIANTS)


def test_hot_prefix_has_one_edge_row(spark):
    words = spark.range(3000).select(F.col("id").alias("wid"), F.concat(F.lit("common"), F.lpad(F.hex("id"), 4, "q")).alias("word"), F.lit(3).alias("n"))
    nodes = spelling.edge_table(words)
    assert nodes.count() == nodes.select("node").distinct().count()
    assert nodes.agg(F.max(F.size("children"))).first()[0] <= 17


def test_spent_states_need_a_letter_that_follows(spark):
    draw = random.Random(5)
    words = {"".join(draw.choice("abcde") for _ in range(8)) for _ in range(2000)}
    words = spark.createDataFrame(list(enumerate(sorted(words))), "wid long, word string")
    nodes = spelling.edge_table(words)
    states = spelling._step(words.mapInArrow(spelling._seeds, spelling.STATE), nodes).filter("other is null and edits = 1")
    assert states.count() > 0
    assert states.join(nodes, "node").filter("exists(children, x -> x.c = ascii(left))").count() == states.count()


@pytest.mark.parametrize("at_once, together", [(1, 1), (1, 300), (50, 1 << 20), (1 << 20, 1 << 20)])
def test_words_are_counted_over_any_slices(monkeypatch, at_once, together):
    monkeypatch.setattr(spelling, "TEXT_BYTES", at_once)
    monkeypatch.setattr(spelling, "HELD_BYTES", together)
    texts = ["", None, "Zürich", "zÜrich ×÷ÀÿĀā", "abcde" * 50, "abcde", "fghij", "ÿ", "éé éééé Ééééé", "ab 12cdefg_cdefg😀cdefg", "a" * 3000] * 4
    rows = [(None if i % 7 == 3 else f"d{i}", t) for i, t in enumerate(texts)]
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows]), pa.array([t or "" for _, t in rows])], ["doc_id", "text"])
    for least, every in ((5, 97), (5, 2), (1, 1), (0, 1), (2, 0)):
        found, wanted = Counter(), Counter()
        for out in spelling._counts(least, every)(iter([batch.slice(0, 7), batch.slice(7, 0), batch.slice(7)])):
            for word, n in zip(*(c.to_pylist() for c in out.columns)):
                found[word] += n
        for doc_id, text in rows:
            for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
                run = run.translate(LOWER)
                h = zlib.crc32(f"{doc_id or ''}:{run}".encode())
                run = run[:h % len(run)] + run[h % len(run) + 1:] if every and h % every == 0 else run
                wanted[run] += len(run) >= least
        assert found == +wanted


# -- conversations ----------------------------------------------------------------------------------------------------

def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute_repair(rows):
    """Memoised search over (row, state): the cheapest, then ASCII-least rest of the audit."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
    faults, seen = [], set()
    for _, _, role, text in rows:
        bare = text.strip(WHITE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[2][:1] or " " for r in rows]
    keep = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    due = {"": "u", "s": "u", "a": "u", "u": "a"}

    best = {(len(rows), s): r for s, r in {"": (0, ""), "a": (0, ""), "u": (2, "I"), "s": (4, "II")}.items()}
    for i in range(len(rows) - 1, -1, -1):
        extra, own = int(faults[i] == "truncated"), {}
        for s in ("", "s", "u", "a"):
            options = [(3 + best[i + 1, s][0], "D" + best[i + 1, s][1])]
            if faults[i] not in ("blank", "duplicate"):
                if (s, initials[i]) in keep:
                    c, a = best[i + 1, keep[s, initials[i]]]
                    options.append((c + extra, "K" + a))
                c, a = best[i + 1, due[s]]
                options.append((c + 2 + extra, "R" + a))
            own[s] = min(options)
        for _ in range(3):
            for s in own:
                c, a = own[due[s]]
                own[s] = min(own[s], (c + 2, "I" + a))
        best |= {(i, s): r for s, r in own.items()}
    cost, audit = best[0, ""]
    state, at, out, names = "", 0, [], {"u": "user", "a": "assistant"}
    for edit in audit:
        if edit == "I":
            state = due[state]
            out.append(names[state] + ":")
            continue
        if edit == "K":
            state = initials[at]
            out.append(rows[at][2] + ":" + rows[at][3])
        if edit == "R":
            state = due[state]
            out.append(names[state] + ":" + rows[at][3])
        at += 1
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
            hashlib.sha256("\n".join(out).encode()).hexdigest())


def brute_table(given, rows):
    grouped = defaultdict(list)
    for row in rows:
        grouped[row[0]].append(row)
    return [(conv, *brute_repair(grouped[conv])) for conv in {r[0] for r in given}]


CONVERSATION = "conv_id long, turn long, role string, text string, seq long, cost string"


def talk(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], CONVERSATION)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.001"])
def test_conversation_query_is_brute_force(spark, sf):
    given = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(queries.op12_conversations(spark, f"/root/testdata/{sf}"), brute_table(given, brute_damage(given)), REPAIRED)


@pytest.mark.parametrize("chunk", [4096, 3])
def test_repair_of_awkward_conversations(spark, chunk):
    draw = random.Random(3)
    texts, roles = ["Yes.", "No", "", " \t", "Why?", "So!  ", None, "é…", "x" * 50_000 + "."], ["user", "assistant", "system", "User", "", None, "tool", "s"]
    given = [(conv, draw.choice([None, *range(12)]), draw.choices(roles, [8, 8, 3, 1, 1, 1, 1, 1])[0], draw.choice(texts)) for conv in range(60) for _ in range(draw.randint(1, 14))]
    given += [(None, t, "user", "null id.") for t in (0, 1, None)] + [(70, 5, "user", "again.")] * 40 + [(71, t, "system", f"s{t}.") for t in range(6)]
    given += [(72, t, "user" if t % 2 else "assistant", f"long {t}.") for t in range(300)] + [(73, -5, "assistant", "late"), (73, 9, "user", "gap.")]
    df = talk(spark, given)
    for rows, table in ((brute_damage(given), conversations.damaged(df)), ([(c, t, r or " " if r is None else r, " " if x is None else x) for c, t, r, x in given], df)):
        same(conversations.summary_with_digests(df, conversations.repair(table, chunk)), brute_table(given, rows), REPAIRED)


def test_empty_conversations(spark):
    none = talk(spark, [])
    repaired = conversations.repair(conversations.damaged(none))
    assert conversations.summary_with_digests(none, repaired).count() == 0 == repaired.edits.count()


def test_edits_carry_the_repaired_turns(spark):
    df = talk(spark, [(1, 0, "system", "Be kind."), (1, 1, "user", "Hello."), (1, 2, "user", "Are you there?"), (1, 3, "assistant", " "), (1, 4, "assistant", "Yes.")])
    edits = conversations.repair(df).edits.orderBy("seq", "pos").select("edit", "turn", "role", "text").collect()
    assert [tuple(r) for r in edits] == [
        ("K", 0, "system", "Be kind."), ("K", 1, "user", "Hello."), ("I", None, "assistant", ""), ("K", 2, "user", "Are you there?"),
        ("D", 3, "assistant", " "), ("K", 4, "assistant", "Yes.")]


def test_least_audit_equals_enumeration():
    """Every audit of short conversations: Hirschberg finds the cheapest, then the least."""
    @lru_cache(None)
    def every(i, s, left, rows):
        if left < 0:
            return []
        out = [(0, "")] if i == len(rows) and s in (0, 3) else []
        out += [(c + 2, "I" + a) for c, a in every(i, conversations.NEXT[s], left - 2, rows)]
        if i < len(rows):
            for e, a, b, cost in conversations._moves(*rows[i]):
                if a == s:
                    out += [(c + cost, e + x) for c, x in every(i + 1, b, left - cost, rows)]
        return out

    draw = random.Random(5)
    for _ in range(150):
        rows = tuple((draw.choice("suua a"), draw.choice([None, None, "truncated", "blank"])) for _ in range(draw.randint(1, 5)))
        cost, audit = min(every(0, 0, 3 * len(rows), rows))
        coded = [(conversations._moves(*r), 0) for r in rows]
        found, end = conversations.least_audit(coded, 0, conversations.END)
        assert found + "I" * (conversations.END[end] // 2) == audit
        assert conversations.backward(conversations.END, coded)[0] == cost


# -- lines ------------------------------------------------------------------------------------------------------------

def brute_lines(rows, least=20, docs=3):
    def key(line):
        return line.strip(WHITE).translate(LOWER)

    holders = defaultdict(list)
    for i, (doc_id, text) in enumerate(rows):
        for k in {key(x) for x in text.split("\n")}:
            if len(k) >= least:
                holders[k].append((doc_id is not None, doc_id or 0))
    out = []
    for doc_id, text in rows:
        own = (doc_id is not None, doc_id or 0)
        parts = text.split("\n")
        kept = [x for x in parts if len(holders.get(key(x), ())) < docs or max(holders[key(x)]) == own]
        out.append((doc_id, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return out


LINES = ["the same boilerplate line here", "  The SAME boilerplate line here\t", "short", "", "ÉCOLE primaire et secondaire", "école primaire et secondaire",
         "exactly twenty chars", "nineteen characters", " the same boilerplate line here", "line\rwith a carriage return inside\r", "日本語" * 7]


@pytest.mark.parametrize("segments", [1024, 1])
def test_lines(spark, segments):
    draw = random.Random(9)
    more = ["\n".join(draw.choice(LINES) for _ in range(draw.randint(1, 30))) for _ in range(60)]
    more += ["\n" * 5000, "\n".join(f"a line of its own, number {i}" for i in range(20_000)), "x" * 100_000 + "\n" + LINES[0]]
    for df in (awkward(spark, more), empty(spark), spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        same(lines.drop_repeated_lines(df, most_segments=segments), brute_lines(pairs(df)), ["doc_id", "n_lines", "n_dropped", "kept"])


def test_full_filters_suspect_every_line_and_lose_none(spark, monkeypatch):
    """Where the broadcast bound makes the filters too small, results stay."""
    import numpy as np

    df = awkward(spark, ["\n".join(LINES)] * 4)
    monkeypatch.setattr(lines, "twice_seen", lambda rows, least, segments: np.full((segments, lines.BITS // 8), 255, np.uint8))
    same(lines.drop_repeated_lines(df), brute_lines(pairs(df)), ["doc_id", "n_lines", "n_dropped", "kept"])


def test_filters_keep_single_lines_out(spark):
    """What is seen once is rarely suspected, what is seen twice always is."""
    import numpy as np
    import pyarrow as pa

    df = spark.range(4000).select(F.concat(F.lit("a line of this document only: "), F.col("id")).alias("text"))
    twice = df.limit(50).unionByName(df)
    bits = lines.twice_seen(twice, 20, 1)
    _, _, key, words, hashes = lines._held_keys(pa.array([r[0] for r in df.collect()]), 20)
    segment, places = lines._places(hashes, 1)
    likely = np.logical_and.reduce([bits[segment, p >> 3] >> (p & 7) & 1 for p in places])
    known = {r[0].encode() for r in df.limit(50).collect()}
    assert all(s for w, s in zip(words, likely) if w in known)
    assert sum(likely) < 50 + 40
