"""The training-data operators against brute force, on given tables and on awkward rows."""

import hashlib
import math
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from mediasieve.llm import (common, exact, mixing, mtree, packing, quality, queries, repeats, simhash, token_counts, token_files, tokens,
                            toxicity)
from mediasieve.session import scratch_folder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, target double, _text string, kept string"
SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PASSAGE = "every good passage of this little corpus stands here once more, word for word and byte for byte"
TEXTS = [
    None, "", " ", "\n\t", "one", "two  words", "two words", "Two Words", "two\twords\n", "naïve café — 日本語 text 😀", "a b  c　 d",
    "<|endoftext|> inside <|startoftext|> of text<|endoftext|>", "x\x00y \x00 z", "I'll don't we've 's 't  it's   THEY'RE", "é ́ ΑΣ Σ ΣΑΣ.",
    PASSAGE, "before it " + PASSAGE + " and after", PASSAGE + " " + PASSAGE, "In. " * 3000, "long " + " ".join(f"w{i % 977}" for i in range(20000)),
    "\x1c sep \x1f \x85 next line", "   lead and trail   ", "12 345 6,789.00 -- !!", "aaaa" * 50, "ab" * 40, "a ~ b ~~ c~d ~", "~",
]


def awkward(spark, extra=()):
    rows = [(i * 3 + 1, t, "en", ["src0", "src1", None][i % 3]) for i, t in enumerate([*TEXTS, *extra])]
    rows += [(None, "no id at all", "en", "src0"), (None, None, None, None), (4, "", "en", "src1"), (16, "two  words", "en", "src0"),
             (16, "two  words", "en", "src0"), (1000, PASSAGE, "de", "src2"), (999, PASSAGE, "de", "src2"), (-5, "negative " + PASSAGE, "de", "")]
    return spark.createDataFrame([(*r, 1, 2, 3.0, "clash", "clash") for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def key(row):
    return tuple((x is None, x or 0) if not isinstance(x, (str, bytes, bool)) else (False, x) for x in row)


def same(df, expected, columns):
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=key)
    assert got == sorted(expected, key=key)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.mark.parametrize("path, kind", [(BYTE, "bytes"), (WORD, "words")])
def test_pieces_give_the_ids_of_whole_texts(docs, path, kind):
    import pyarrow as pa

    tokenizer, encoder = Tokenizer.from_file(path), tokens.Encoder(path, kind)
    texts = [t or "" for t in TEXTS] + [t for _, t in pairs(docs)]
    letters = [*"aAkKsStTéÉßİJ0.,;:!?'\"<>|~- \n\u0301\u030c\u037e\x00\u3000日😀\u00a0", "'s", "don't,", "<|endoftext|>", "<|ENDOFTEXT|>", "x.y"]
    draw = np.random.default_rng(7)
    texts += ["".join(draw.choice(letters, size)) for size in draw.integers(0, 40, 3000)]
    flat, at = encoder.encode(pa.array(texts), end_id=None)
    for i, text in enumerate(texts):
        assert flat[at[i]:at[i + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text[:80])
    assert encoder.counts(pa.array([None, "one"])).tolist() == [0, 1]


def test_token_counts(spark, docs):
    tokenizer = Tokenizer.from_file(BYTE)
    for df in (awkward(spark), docs, empty(spark)):
        for bound in (1_000_000, 0):
            cache = scratch_folder(spark, "cache")
            expected = [(i, len(t.encode()), len(tokenizer.encode(t, add_special_tokens=False).ids)) for i, t in pairs(df)]
            same(token_counts.count_tokens(df, BYTE, cache, ship_rows=bound), expected, ["doc_id", "n_bytes", "n_tokens"])
            if df is docs:
                continue
            n = token_counts.read_cache(spark, cache, tokens.file_digest(BYTE)).count()
            assert n == len({t for _, t in pairs(df)})
            more = df.unionByName(spark.createDataFrame([(5000, "a new text", "en", "s", 1, 1, 1.0, "", "")], SCHEMA))
            again = token_counts.count_tokens(more, BYTE, cache, ship_rows=bound)
            same(again, expected + [(5000, 10, 3)], ["doc_id", "n_bytes", "n_tokens"])
            assert spark.read.parquet(cache).count() == n + 1       # only the new content was encoded
            token_counts.count_tokens(df, WORD, cache, kind="words").count()
            assert token_counts.read_cache(spark, cache, tokens.file_digest(WORD)).count() == n


def brute_top_k(rows, k=20):
    out = []
    for q, v in rows:
        if q % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return out


@pytest.mark.parametrize("shard_rows", [16_384, 40])
def test_top_k(spark, shard_rows):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8))
    x[50:150] = x[50]                               # a hot vector
    x[200:220] = 0
    rows = [(i, [float(np.float32(a)) for a in v]) for i, v in enumerate(x)]
    odd = [(1000, None), (1020, [1.0, None] + [0.0] * 6), (1040, [math.nan] * 8), (1060, [math.inf] * 8), (None, [0.5] * 8), (1080, []),
           (1100, [1.0, 2.0]), (1101, [2.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, "c", 0) for i, v in rows + odd], "vec_id long, embedding array<float>, score int, rank string, id int")
    good = [(i, [math.floor(64 * a) for a in v]) for i, v in rows + [odd[-3], odd[-2], odd[-1]]]
    found = mtree.top_k(df, F.col("vec_id") % 20 == 0, shard_rows=shard_rows)
    same(found, brute_top_k(good), ["query_id", "rank", "vec_id", "score"])
    assert mtree.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_tree_avoids_distances():
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(30, 16)) * 300
    x = np.floor(centers[rng.integers(0, 30, 6000)] + rng.normal(size=(6000, 16)) * 5)
    tree = mtree.MTree(np.arange(6000), x)
    seen, most = [], mtree._most
    mtree._most = lambda *a: seen.append(np.size(a[2])) or most(*a)
    try:
        _, ids, scores = tree.search(x[:1], np.array([0]), 20, np.array([np.nan]))
    finally:
        mtree._most = most
    assert sum(seen) < 3000
    assert [*zip(scores, ids)] == sorted(((int(s), i) for i, s in enumerate(x @ x[0]) if i), key=lambda p: (-p[0], p[1]))[:20]


def test_tree_searches_blocks():
    rng = np.random.default_rng(2)
    for case in range(12):
        n, span, k = int(rng.integers(1, 1500)), int(rng.integers(1, 20)), int(rng.integers(1, 25))
        x = rng.integers(-span, span + 1, (n, int(rng.integers(1, 9)))).astype(float)
        x[:n // 2] = x[0] if case % 3 == 0 else x[:n // 2]
        ids = rng.permutation(2 * n)[:n]
        ids[:n // 4] = ids[0] if case % 5 == 0 else ids[:n // 4]
        floors = np.where(np.arange(len(ids[::3])) % 2 * (case % 2), float(rng.integers(-span, span * span)), np.nan)
        place, found, scores = mtree.MTree(ids, x).search(x[::3], ids[::3], k, floors)
        for a, own in enumerate(ids[::3]):
            every = sorted((-s, i) for s, i in zip((x @ x[3 * a]).astype(int).tolist(), ids.tolist()) if i != own and not s < floors[a])
            assert [*zip((-scores[place == a]).tolist(), found[place == a].tolist())] == every[:k]


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        share = sum(weight[s] for s in names if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / share for s in names}
        over = {s for s in names if s not in capped and target[s] >= 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mix(spark, docs):
    skewed = docs.withColumn("source", F.when(F.col("doc_id") < 4, F.concat(F.lit("tiny"), F.col("doc_id").cast("string")))
                             .when(F.col("doc_id") % 3 == 0, None).when(F.col("doc_id") < 100, "hot").otherwise("rest"))
    for df, near in ((docs, 60), (skewed, 60), (awkward(spark), 60), (docs.withColumn("source", F.lit("one")), 60)):
        found = mixing.mix(df, shard_rows=50).join(df.select("doc_id", "source").distinct(), "doc_id").collect()
        sizes, taken = Counter(), Counter()
        for r in mixing.mix(df, shard_rows=50, carry=("source",)).collect():
            sizes[r["source"]] += r["size"]
            taken[r["source"]] += r["taken"]
            assert 0 <= r["taken"] <= 3 * r["size"]
        target = brute_targets(sizes)
        for r in found:
            assert r["size"] == r["size"]
        for r in mixing.mix(df, shard_rows=50, carry=("source",)).collect():
            assert r["source_size"] == sizes[r["source"]]
            assert r["target"] == pytest.approx(target[r["source"]])
        for s in sizes:
            assert abs(taken[s] - target[s]) <= max(near, 0.01 * target[s]), s
        words = {(i, len(WORDS.findall(t))) for i, t in pairs(df)}
        assert {(r["doc_id"], r["size"]) for r in found if r["doc_id"] is not None} == {w for w in words if w[0] is not None}
        once, again = (sorted(map(tuple, mixing.mix(df.repartition(n), shard_rows=50).collect()), key=key) for n in (2, 5))
        assert once == again
    assert mixing.mix(empty(spark)).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixing.mixed_documents(awkward(spark)).columns == awkward(spark).columns
    got = Counter()
    for i, t in pairs(mixed):
        got[i] += len(WORDS.findall(t))
    assert got == Counter({r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect() if r["taken"]})


def test_seats_are_those_of_the_highest_quotients(spark):
    rng = np.random.default_rng(3)
    cases = [(g, p, int(v), int(s)) for g in range(12) for s in [rng.integers(0, 60)] for p, v in enumerate(rng.integers(0, 90, 1 + g))]
    df = spark.createDataFrame(cases, "g int, p int, votes long, seats long")
    df = df.withColumn("votes", F.col("votes").cast("double")).join(df.groupBy("g").agg(F.sum("votes").cast("double").alias("total")), "g")
    got = {(r["g"], r["p"]): r["quota"] for r in mixing.sainte_lague(df.filter("total > 0"), "votes", "seats", "total", ["g"], ["p"]).collect()}
    for g in range(12):
        votes = {p: v for h, p, v, _ in cases if h == g}
        if sum(votes.values()) == 0:
            continue
        quota = Counter()
        for _ in range(next(s for h, _, _, s in cases if h == g)):
            quota[max(votes, key=lambda p: (votes[p] / (2 * quota[p] + 1), -p))] += 1
        assert {p: got[g, p] for p in votes} == {p: quota[p] for p in votes}


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    trie, weights = toxicity.train(docs, labels)
    rows = toxicity.score(docs, trie, weights).join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    hit = sum(r["predicted"] for r in rows if r["toxic"]) / sum(r["toxic"] for r in rows)
    false = sum(r["predicted"] for r in rows if not r["toxic"]) / sum(1 - r["toxic"] for r in rows)
    assert hit > 0.85 and false < 0.01
    texts = [(1, "the and of you idi0t, thing"), (2, "the and of a thing"), (3, 'a word said "idiot" the and'), (4, "you IDIOT!! of"), (5, None), (6, "")]
    df = spark.createDataFrame([(i, t, 0.0, 1) for i, t in texts] + [(None, "idiot", 0.0, 1)], "doc_id long, text string, score double, predicted int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, trie, weights).collect()}
    assert got[4] > 0.5 and got[None] > 0.5 and got[1] > got[2] and got[3] < got[4] and got[5] == got[6] == got[2]
    assert toxicity.score(df.limit(0), trie, weights).count() == 0
    trie, weights = toxicity.train(docs.limit(0), labels.limit(0))
    assert {r["score"] for r in toxicity.score(df, trie, weights).collect()} != set()


def test_words_of_a_stem_keep_their_misspellings(spark):
    family = ["grobian", "grobheit", "grobsack", "grobling"]
    rows = [(w, 40, 0) for w in family] + [("freundlich", 2, 900), ("grabheit", 0, 30)]
    trie = toxicity.learn_lexicon(spark.createDataFrame(rows, "word string, n1 long, n0 long"), 0.1)
    assert [trie.match(w) for w in family] == [1, 1, 1, 1] and trie.match("grobes") == 1      # the stem is learned
    assert [trie.match(w) for w in ("gr0bian", "gobling", "gorbsack")] == [2, 2, 0]           # a swap is two edits
    assert trie.match("grabheit") == 0 and trie.match("freundlich") == 0                      # a word of clean texts


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_is_edit_distance():
    terms = ["idiot", "worthless", "scum", "trash", "disgusting", "idol"]
    trie, rng = toxicity.FuzzyTrie(terms, ["réeux"]), np.random.default_rng(2)
    for _ in range(4000):
        word = list(terms[rng.integers(len(terms))])
        for _ in range(rng.integers(0, 4)):
            at = rng.integers(len(word) + 1)
            word[at:at + rng.integers(0, 2)] = list("abdiost")[rng.integers(0, 7):][:rng.integers(0, 2)]
        word = "".join(word)
        expected = 1 if word in terms else 2 if any(levenshtein(word, t) <= toxicity.edits_of(t) for t in terms) else 0
        assert trie.match(word) == expected, word
    assert trie.match("réeuxment") == 1 and trie.match("réeu") == 0


def check_pieces(found, texts, window=2048):
    tokenizer = Tokenizer.from_file(WORD)
    whole = Counter()
    for i, t in texts:
        whole[i, tuple([*tokenizer.encode(t, add_special_tokens=False).ids, 1])] += 1
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for s, rows in by_sequence.items():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= window and (at == window or at & (at - 1) == 0)       # no padding at all
    expected, got = Counter(), Counter()
    for (i, ids), n in whole.items():
        expected[i, len(ids)] += n * len(ids)
    for i, rows in by_doc.items():
        for r in rows:
            got[i, r["doc_tokens"]] += r["length"]
    assert got == expected
    singles = {i: ids for (i, ids), n in whole.items() if n == 1 and sum(k[0] == i for k in whole) == 1}
    for i, ids in singles.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at:at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)


def test_packing(spark, docs):
    for df in (awkward(spark), docs):
        found = packing.pack(df, WORD, shard_bytes=200_000).collect()
        check_pieces(found, pairs(df))
        again = packing.pack(df.repartition(3), WORD, shard_bytes=200_000).collect()
        assert sorted(map(tuple, found), key=key) == sorted(map(tuple, again), key=key)
    assert packing.pack(empty(spark), WORD).count() == 0


def test_packing_takes_neighbours():
    rng = np.random.default_rng(0)
    topics = [rng.integers(100 * t, 100 * t + 40, 60) for t in range(8) for _ in range(8)]
    order = rng.permutation(64)
    ids, at = np.concatenate([topics[i] for i in order]).astype(np.uint32), np.arange(65) * 60
    packed = packing.packing_order(ids, at, np.arange(64), window=240)
    topic = [order[d] // 8 for d in packed]
    assert sorted(packed) == list(range(64)) and sum(a == b for a, b in zip(topic[:-1], topic[1:])) >= 48


def test_packing_neighbours_meet_over_shards(spark):
    """Of pairs that brute force over all documents finds nearest to each other, most share a shard."""
    rng, words = np.random.default_rng(4), "river stone cloud table horse glass paper light winter garden music bread".split()
    names = [f"{a}{b}{c}" for a in words for b in words for c in ("ton", "berg")]
    texts = []
    for t in range(150):
        own, common = names[t], rng.choice(words, 60).tolist()
        texts += [f"{own} {own} {own} " + " ".join(rng.permutation(common[:50 + k])) for k in range(4)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = packing.pack(df, WORD, shard_bytes=20_000).collect()
    check_pieces(found, list(enumerate(texts)))
    shard = {r["doc_id"]: r["sequence_id"] >> 32 for r in found}
    tokenizer = Tokenizer.from_file(WORD)
    encoded = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    at = np.concatenate([[0], np.cumsum([len(e) for e in encoded])])
    whole = packing.Bm25(np.concatenate(encoded).astype(np.uint32), at)
    best = []
    for d in range(len(texts)):
        used = np.zeros(len(texts), bool)
        used[d] = True
        best += [(d, n) for n in whole.neighbours(d, used)[:3]]
    share = sum(shard[a] == shard[b] for a, b in best) / len(best)
    print("neighbour share", share, "shards", len(set(shard.values())))
    assert len(set(shard.values())) >= 6 and share > 0.5


def brute_repeats(rows, length=50):
    ranked = [(i if i is not None else math.inf, i, t.encode()) for i, t in rows]
    first = {}
    for rank, _, t in ranked:
        for k in range(len(t) - length + 1):
            s = t[k:k + length]
            first[s] = min(first.get(s, math.inf), rank)
    out = []
    for rank, i, t in ranked:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if first[t[k:k + length]] < rank:
                gone[k:k + length] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).digest()))
    return out


@pytest.mark.parametrize("options", [{}, {"slice_bytes": 30_000, "bucket_bytes": 40_000, "crowded": 2}, {"slice_bytes": 100_000, "crowded": 0}])
def test_repeats(spark, docs, options):
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    rng = np.random.default_rng(4)
    extra = ["".join("ab"[b] for b in rng.integers(0, 2, 400)) for _ in range(4)] + ["start %d %s end %d" % (i, PASSAGE[i:], i) for i in range(40)]
    for df in (awkward(spark, extra), docs):
        same(repeats.remove_repeats(df, digest=True, **options), brute_repeats(pairs(df)), columns)
    assert repeats.remove_repeats(empty(spark), **options).count() == 0


def test_repeats_give_the_bytes_left(spark):
    df = spark.createDataFrame([(2, "x " + PASSAGE + " y"), (1, PASSAGE)], "doc_id long, text string")
    assert {r["doc_id"]: bytes(r["kept"]) for r in repeats.remove_repeats(df).collect()} == {1: PASSAGE.encode(), 2: b"x  y"}


def test_token_files(spark, docs):
    tokenizer = Tokenizer.from_file(WORD)
    for df in (awkward(spark), docs, empty(spark)):
        path = scratch_folder(spark, "orc")
        token_files.write_token_files(df, path, WORD)
        rows = [(i, [*tokenizer.encode(t, add_special_tokens=False).ids, 1]) for i, t in pairs(df)]
        got = sorted((tuple(r) for r in token_files.file_manifest(spark, path).select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
        start = 0
        for r in got:
            assert r[0] == start
            start += r[2]
        assert [r[1] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is None, i or 0))
        assert Counter(r[1:] for r in got) == Counter((i, len(t), zlib.crc32(np.array(t, "<u4").tobytes())) for i, t in rows)
        if df is docs:
            some = token_files.read_token_files(spark, path, [rows[3][0], -77])
            assert [list(r["ids"]) for r in some.collect()] == [rows[3][1]]
            assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().toString()


@pytest.mark.parametrize("most_bits", [1 << 28, 1 << 15])
def test_exact_duplicates(spark, docs, most_bits):
    for df in (awkward(spark), docs, empty(spark)):
        groups = defaultdict(list)
        for i, t in pairs(df):
            groups[SPACE.sub(" ", t)].append(i)
        expected = []
        for ids in groups.values():
            keep = min(ids, key=lambda i: (i is None, i or 0))
            free = 1        # of rows that repeat the id, one stays
            for i in ids:
                expected.append((i, keep, len(ids), i == keep and free > 0))
                free -= i == keep
        same(exact.mark_duplicates(df, most_bits=most_bits), expected, ["doc_id", "keep_id", "group_size", "kept"])
        kept = exact.drop_duplicates(df, most_bits=most_bits)
        assert kept.columns == df.columns and kept.count() == len(groups)


def test_exact_duplicates_outlive_other_splits(spark, docs):
    """Files are cut differently when the rows are read again, as after a lost executor."""
    path = scratch_folder(spark, "copies")
    docs.select("doc_id", F.concat(F.lit("text "), (F.col("doc_id") % 5).cast("string")).alias("text")).repartition(8).write.parquet(path)
    df, cost = spark.read.parquet(path), "spark.sql.files.openCostInBytes"
    before = spark.conf.get(cost), spark.conf.get("spark.sql.files.minPartitionNum", None)
    try:
        spark.conf.set("spark.sql.files.minPartitionNum", 8)
        marked, kept = exact.mark_duplicates(df), exact.drop_duplicates(df)
        spark.conf.set("spark.sql.files.minPartitionNum", 1)
        spark.conf.set(cost, 1)
        assert df.rdd.getNumPartitions() < 8
        assert marked.filter("kept").count() == 5 and kept.count() == 5
    finally:
        spark.conf.set(cost, before[0])
        spark.conf.unset("spark.sql.files.minPartitionNum") if before[1] is None else spark.conf.set("spark.sql.files.minPartitionNum", before[1])


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, ids, distance=4):
    distinct = np.unique(np.array(values, np.uint64))
    parent = list(range(len(distinct)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, v in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(distinct[i + 1:] ^ v) <= distance) + i + 1:
            parent[find(int(j))] = find(i)
    root = {int(v): find(i) for i, v in enumerate(distinct)}
    least = {}
    for v, i in zip(values, ids):
        if i is not None:
            least[root[v]] = min(least.get(root[v], i), i)
    return [least.get(root[v]) for v in values]


@pytest.mark.parametrize("bin_rows", [100_000, 3])
def test_near_duplicates(spark, docs, bin_rows):
    near = [" ".join(f"word{(i * 7) % 500}" if i != j * 11 else "changed" for i in range(300)) for j in range(25)]
    for df in (awkward(spark, near), docs, empty(spark)):
        rows = pairs(df)
        values = [brute_fingerprint(t) for _, t in rows]
        found = brute_components(values, [i for i, _ in rows])
        expected = [(i, f"{v:016x}", c) for (i, _), v, c in zip(rows, values, found)]
        got = simhash.near_duplicates(df, bin_rows=bin_rows).withColumn("fp", F.lpad(F.lower(F.hex("fp")), 16, "0"))
        same(got, expected, ["doc_id", "fp", "component_id"])


def test_golay_keys_find_every_link():
    assert (simhash.near_patterns()[:, 0] >= 0).all()           # a perfect code: each remainder has a near codeword
    rng = np.random.default_rng(8)
    x = rng.integers(0, 1 << 63, 600, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 600, dtype=np.uint64)
    y = x.copy()
    for i in range(len(x)):
        for b in rng.choice(22 if i % 3 == 0 else 64, i % 5, replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    (rx, kx), (ry, ky) = simhash.keys(x), simhash.keys(y)
    mine, other = defaultdict(set), defaultdict(set)
    for r, k in zip(rx.tolist(), kx.tolist()):
        mine[r].add(k)
    for r, k in zip(ry.tolist(), ky.tolist()):
        other[r].add(k)
    assert all(mine[i] & other[i] for i in range(len(x)))


def test_components_of_long_chains(spark):
    edges = [(i + 1, i) for i in range(200)] + [(1000 + i, 1000) for i in range(1, 50)] + [(5000, 4000), (5000, 3000)]
    got = {r["a"]: r["b"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1000 + i: 1000 for i in range(1, 50)} | {5000: 3000, 4000: 3000}


def test_quality(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.graded(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    right = sum(r["selected"] == (r["quality"] == 1) for r in rows) / len(rows)
    kept = sum(r["selected"] for r in rows if r["quality"] == 1) / sum(r["quality"] for r in rows)
    print("quality", right, kept)
    assert right > 0.97 and kept > 0.985
    assert all(0 <= r["tail"] <= 1 and r["tail"] <= r["expected_grade"] <= 2 * r["tail"] + 1e-9 for r in rows)
    odd = awkward(spark).withColumn("tail", F.lit(1)).withColumn("selected", F.lit("x"))
    model = quality.train(docs.limit(300), labels)
    got = quality.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r["tail"] <= 1 for r in got)
    assert len({r["tail"] for r in got if r["doc_id"] in (1, 4, 7)}) == 1       # null, empty and blank
    assert quality.score(odd.limit(0), model).count() == 0
    none = quality.train(docs, labels.limit(0))
    assert {r["selected"] for r in quality.score(odd, none).collect()} == {True}
    chosen = quality.select_documents(odd, labels)
    assert chosen.columns == odd.columns


def test_ordinal_thresholds_rise():
    rng = np.random.default_rng(6)
    n = 600
    feature = rng.integers(0, 50, (n, 5))
    truth = rng.normal(size=50) * 2
    grades = np.digitize(truth[feature].sum(axis=1) + rng.logistic(size=n), [-2, 2])
    model = quality.Ordinal.fit(np.repeat(np.arange(n), 5), feature.ravel(), np.ones(5 * n), grades)
    assert model.thresholds[0] < model.thresholds[1]
    assert np.corrcoef(model.weights[:50], truth)[0, 1] > 0.9


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    documents = common.documents(spark, sf)
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, common.materialize(stage(spark, docs, sf), name)
        assert docs.columns == documents.columns
        if name == "quality_classifier":
            scores = {r["doc_id"]: r["selected"] for r in queries.op10_quality(spark, sf).collect()}
            assert {i for i, _ in pairs(docs)} == {i for i, s in scores.items() if s}
        if name == "exact_dedup":
            assert len(pairs(docs)) == len({SPACE.sub(" ", t) for _, t in pairs(before)})
        if name == "near_dedup":
            rows = pairs(before)
            found = brute_components([brute_fingerprint(t) for _, t in rows], [i for i, _ in rows])
            assert sorted(i for i, _ in pairs(docs)) == sorted(set(found))
        if name == "mixing":
            words = Counter()
            for i, t in pairs(docs):
                words[i] += len(WORDS.findall(t))
            assert words == Counter({r["doc_id"]: r["taken"] for r in mixing.mix(before).collect() if r["taken"]})
    check_pieces(corpus_pipeline.packing_stage(spark, docs, sf).collect(), pairs(docs))
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, documents.limit(0), sf)
        assert none.count() == 0


def test_each_round_of_refinement_removes_rows(spark):
    """Length, prefix, full hash: only rows that share what came before are hashed."""
    head = "h" * exact.PREFIX
    texts = ["a", "bb", "cc", "ddd" * 30, "ddd" * 30, head + "x", head + "y", "of one length only" * 9]
    rows = spark.createDataFrame([(t,) for t in texts], "_text string")
    hashed = {r[0] for r in exact.refined(rows).filter("_hash is not null").collect()}
    assert hashed == {"ddd" * 30, head + "x", head + "y"}                  # bb and cc share a length, not a prefix
    keys = rows.withColumn("_hash64", F.xxhash64(F.length("_text")))
    bitmap, bits = exact.bits_of(exact._shared(keys.select("_hash64")), "lengths", 1 << 28)
    assert {r[0] for r in exact.maybe_held(keys, bitmap, bits).filter("_maybe").collect()} == set(texts) - {"a", "of one length only" * 9}
    # a full bitmap lets every row through and changes no result
    same(exact.mark_duplicates(rows.withColumn("doc_id", F.monotonically_increasing_id()), text_col="_text", most_bits=1), [
        (1, 1), (1, 1), (1, 1), (2, 1), (2, 0), (1, 1), (1, 1), (1, 1)], ["group_size", F.col("kept").cast("int")])


def test_queries_of_one_id_rank_for_themselves(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 6)).round(3).tolist()
    rows = [(i + 1, v) for i, v in enumerate(x)] + [(20, x[30]), (20, x[19]), (40, x[39])]
    found = mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 20, shard_rows=16)
    whole = [(i, [math.floor(64 * c) for c in v]) for i, v in rows]
    asked = [(20, whole[19][1]), (20, whole[30][1]), (40, whole[39][1]), (60, whole[59][1])]
    expected = []
    for q, v in asked:
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q)[:20]
        expected += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    same(found, expected, ["query_id", "rank", "vec_id", "score"])


def test_near_duplicates_leave_by_row(spark):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(3, long), (5, long + " end"), (5, "a clean text that has nothing in common with it"), (None, long + " tail"), (None, "another clean text without an id here"),
            (7, "the only text of seven"), (None, None), (9, "")]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, fp string, _id long")
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    fp = {t: simhash.fingerprint((t or "").encode()) for _, t in rows}
    assert all((fp[long] ^ fp[t]).bit_count() <= 4 for t in (long + " end", long + " tail"))
    assert {(r[0], r[1]) for r in kept.collect()} == {(3, long), (5, rows[2][1]), (None, rows[4][1]), (7, rows[5][1]), (9, "")}


def test_worker_memory_of_pieces_is_bounded(monkeypatch):
    """Past the bound the pieces that most batches held stay; ids remain those of whole texts."""
    import pyarrow as pa

    monkeypatch.setattr(tokens, "MEMO_BYTES", 60_000)
    tokenizer, encoder = Tokenizer.from_file(WORD), tokens.Encoder(WORD, "words")
    for i in range(30):
        text = "always here " + " ".join(f"piece{j}x" for j in range(100 * i, 100 * i + 100))
        flat, _ = encoder.encode(pa.array([text]))
        assert flat.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder._held_bytes() < 60_000 + 40_000
    assert "always" in encoder.code and "piece5x" not in encoder.code


def test_dealing_numbers_shards_without_the_driver(spark):
    """Shards are full, parts of a hot term are spread, equal documents of one term share a shard when they fit."""
    rows = spark.range(4000).select((F.col("id") % 7 * (F.col("id") % 3 > 0).cast("int")).alias("_t1"), (F.col("id") % 5).alias("_t2"),
                                    F.xxhash64("id").alias("_row_hash"), F.lit(100).cast("long").alias("n_bytes"))
    plan = packing.dealing(rows, 20_000)
    placed = packing._placed(rows, plan).join(plan.places, ["_t1", "_p2", "_p3"])
    assert placed.count() == 4000
    sizes = [r[1] for r in placed.groupBy("_shard").agg(F.sum("n_bytes")).collect()]
    assert max(sizes) <= 2 * 20_000 and len(sizes) <= 2 * 4000 * 100 // 20_000
    for small in (0, 500_000):
        packing.PLACES, held = small, packing.PLACES
        again = packing._placed(rows, plan).join(plan.places, ["_t1", "_p2", "_p3"])
        packing.PLACES = held
        assert again.exceptAll(placed).isEmpty()


def test_plain_words_skip_the_normalizer():
    """Words of letters go to the model alone; capitals and marks behind a letter make no further piece."""
    import pyarrow as pa

    encoder, tokenizer = tokens.Encoder(WORD, "words"), Tokenizer.from_file(WORD)
    slow = []
    encoder._joined, joined = lambda words: (slow.extend(words), joined(words))[1], encoder._joined
    texts = ["Été### été ÉTÉ. straße übung*** naïve&&& river River RIVER%%%", "e\u0301te\u0301* E\u0301 \u0130x \u00d7a a\u00f7b \u1e9e \u017f \u212a \u00b5 \u00aa",
             "don't l'été x=\u0338y a*\u0301 b.\u0338 <|endoftext|>) é<|endoftext|> (c) \"d\" e#f $g", "ŒUVRE œuvre ÿ Ÿ þÞ ðÐ"]
    ids, at = encoder.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert {"été", "straße", "river"} <= set(encoder.code) and not {"Été", "ÉTÉ", "Été###", "river%%%"} & set(encoder.code)
    assert not {"été", "straße", "übung", "naïve", "river"} & set(slow)
    rng = np.random.default_rng(8)
    letters = list("abcdeABCDEéÉßñÑüÜ'.,*#%&$)x÷×\u0301\u0130µ9 ~<|>")
    texts = ["".join(rng.choice(letters, 400)) for _ in range(200)]
    ids, at = encoder.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_neighbours_of_both_ways_of_looking():
    """Postings and the documents that are left give the same neighbours; used documents are looked through no more."""
    rng = np.random.default_rng(9)
    lengths = rng.integers(0, 60, 300)
    ids, at = np.minimum(rng.zipf(1.4, lengths.sum()), 400).astype(np.uint32), np.concatenate([[0], np.cumsum(lengths)])
    used, used_too, costs = np.zeros(300, bool), np.zeros(300, bool), (packing.SPAN_COST, packing.POSTING_COST)
    one, other = packing.Bm25(ids, at), packing.Bm25(ids, at)
    try:
        for doc in rng.permutation(300).tolist():
            used[doc] = used_too[doc] = True
            packing.SPAN_COST = packing.POSTING_COST = 0
            by_postings = one.neighbours(doc, used)
            packing.SPAN_COST = packing.POSTING_COST = 1 << 20
            assert by_postings == other.neighbours(doc, used_too)
            assert not used[by_postings].any()
    finally:
        packing.SPAN_COST, packing.POSTING_COST = costs
    assert len(one.left) == len(other.left) == 0
    top = packing.heaviest(ids, at, packing.Corpus(np.bincount(ids), 300, lengths.mean()))
    for doc in range(300):
        terms, tf = np.unique(ids[at[doc]:at[doc + 1]], return_counts=True)
        weight, useful = packing.term_weights(np.bincount(ids)[terms], tf, lengths[doc], packing.Corpus(np.bincount(ids), 300, lengths.mean()))
        best = sorted(zip(-weight[useful], terms[useful]))[:2]
        assert top[doc].tolist() == [*[t for _, t in best], -1, -1][:2]


def test_known_pieces_cost_no_call_each():
    import pyarrow as pa

    encoder = tokens.Encoder(WORD, "words")
    texts = pa.array([" ".join(f"piece{i:x}q" for i in range(at, at + 1000)) for at in range(0, 5000, 1000)])
    first, calls = encoder.encode(texts), []
    sys.setprofile(lambda frame, event, arg: calls.append(event))
    try:
        again = encoder.encode(texts)
    finally:
        sys.setprofile(None)
    assert all(map(np.array_equal, first, again)) and len(calls) < 1000
