"""Splits, registry, screen, ingest and geometry."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from mediasieve import registry
from mediasieve.functions import hashing, naming
from mediasieve.operators import geometry, ingest, ordered, screen, split, validate, views
from mediasieve.plans import bindings, build


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def assigned(spark, dataset, label, generator, n, upstream=""):
    rows = [(dataset, upstream, label, generator, sha(f"{generator}{i}")) for i in range(n)]
    df = spark.createDataFrame(rows, "dataset string, upstream_split string, label int, generator string, raw_sha256 string")
    return Counter(row["split"] for row in split.assign_split(df).collect())


def test_wide_modulo_is_exact(spark):
    values = [sha(str(i)) for i in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "h string")
    got = df.select("h", *[hashing.hex_mod(F.col("h"), m).alias(f"m{m}") for m in (2, 10, 20, 7)]).collect()
    assert all(row[f"m{m}"] == int(row["h"], 16) % m for row in got for m in (2, 10, 20, 7))


def test_held_out_generators_are_always_test(spark):
    for spec in registry.load()["datasets"]:
        for name in spec["held_out"]:
            assert set(assigned(spark, spec["dataset"], 1, name, 200)) == {"test"}


def test_trained_generators_never_reach_test(spark):
    got = assigned(spark, "WildFake_Diffusion", 1, "WildFake/SDXL", 500)
    assert set(got) == {"train", "val"} and got["train"] > 5 * got["val"]


def test_unlisted_generator_goes_whole_to_one_split(spark):
    expected = int(sha("New/Gen"), 16) % 20
    got = assigned(spark, "WildFake_GAN", 1, "New/Gen", 100)
    assert set(got) == {"train" if expected < 16 else "val" if expected < 18 else "test"}


def test_reals_reach_all_splits(spark):
    got = assigned(spark, "WildFake_GAN", 0, "", 2000)
    assert set(got) == {"train", "val", "test"} and 0.75 < got["train"] / 2000 < 0.85


def test_upstream_holdout_is_halved_and_others_refused(spark):
    assert set(assigned(spark, "SID_Set", 0, "", 500, "validation")) == {"val", "test"}
    assert set(assigned(spark, "SID_Set", 1, "SID_Set/FLUX", 50, "train")) == {"train"}
    with pytest.raises(PySparkException, match="unknown upstream split"):
        assigned(spark, "CIFAKE", 0, "", 5, "validation")


def test_registry_shape():
    rows = registry.source_rows()
    # 6 GAN, 15 diffusion and 4 other generators in archives, and one in each labelled dataset.
    assert len({r[11] for r in rows if r[11]}) == 27 and len({r[6] for r in rows if r[6]}) == 38
    assert registry.held_out_axes() == {
        "unseen_diffusion": ["WildFake/Imagen", "WildFake/VQDM"], "unseen_gan": ["WildFake/GigaGAN", "WildFake/starGAN"],
        "unseen_other": ["WildFake/MAGE"]}
    for spec in registry.load()["datasets"]:
        assert not set(spec["held_out"]) & set(spec["trained"])


def test_pinned_sets_do_not_overlap(spark):
    assert split.pinned_overlap(spark).count() == 0


# ── screen ──────────────────────────────────────────────────────────────────

def brute(images, index):
    bands = hashing.band_ranges(6)
    match = lambda a, b: any((a >> lo) & ((1 << hi - lo) - 1) == (b >> lo) & ((1 << hi - lo) - 1) for lo, hi in bands)
    out = {}
    for i, p, d in images:
        near = [(p2, d2) for p2, d2 in index if match(p, p2) or match(d, d2)]
        pmin = min([64, *((p ^ a).bit_count() for a, _ in near)])
        dmin = min([64, *((d ^ b).bit_count() for _, b in near)])
        out[i] = ("drop" if min(pmin, dmin) <= 5 else "review" if min(pmin, dmin) <= 10 else "ok", pmin, dmin)
    return out


@pytest.mark.parametrize("cell, hot_copies", [(2048, 1_000_000), (3, 10)])
def test_screen_matches_brute_force(spark, cell, hot_copies):
    rng = np.random.default_rng(5)
    index = [tuple(int(x) for x in rng.integers(0, 2**64, 2, dtype=np.uint64)) for _ in range(60)]
    images = []
    for i in range(300):
        p, d = (int(x) for x in rng.integers(0, 2**64, 2, dtype=np.uint64))
        if i % 2:
            p, d = index[i % 60]
            for bit in rng.choice(64, i % 13, replace=False):
                p ^= 1 << int(bit)
                d ^= 1 << int(63 - bit)
        images.append((i, p, d))
    images += [(1000 + i, *index[0]) for i in range(150)]          # a third of the rows are one copy
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    left = spark.createDataFrame([(i, signed(p), signed(d)) for i, p, d in images], "id int, phash long, dhash long")
    right = spark.createDataFrame([(signed(p), signed(d)) for p, d in index + index[:9]], "phash long, dhash long")
    got = {r["id"]: (r["verdict"], r["pmin"], r["dmin"]) for r in screen.near_duplicate_verdict(left, right, cell=cell, hot_copies=hot_copies).collect()}
    assert got == brute(images, index)


def test_a_hash_crosses_once_per_block_not_per_band(spark, monkeypatch):
    """Blocks meet whole: rows of the shuffle are those of blocks, a crowded band value is compared in small tiles."""
    monkeypatch.setattr(screen, "TILE", 7)
    rng = np.random.default_rng(6)
    hashes = lambda n: tuple(np.where(np.arange(n) % 3 == 0, rng.integers(0, 2**54, n, dtype=np.uint64) << np.uint64(10), rng.integers(0, 2**64, n, dtype=np.uint64))
                             for _ in range(2))
    mine, theirs = hashes(60), hashes(40)
    pmin, dmin = screen._least_distances(mine, theirs, screen._slots(6))
    wanted = brute([(i, int(p), int(d)) for i, (p, d) in enumerate(zip(*mine))], [(int(p), int(d)) for p, d in zip(*theirs)])
    assert [(min(64, p), min(64, d)) for p, d in zip(pmin.tolist(), dmin.tolist())] == [wanted[i][1:] for i in range(60)]
    probes, pairs = (spark.range(n).selectExpr("xxhash64(id) as phash", "xxhash64(id, 1) as dhash") for n in (6000, 3000))
    rows, columns = screen._blocks(6000, 3000, 2048, 8)
    assert (rows, columns) == (3, 1) and screen._blocks(900_000, 36_000_000, 2048, 12) == (1, 48) and screen._blocks(5_400_000, 216_000_000, 2048, 12) == (3, 108)
    plan = screen._nearest(probes, pairs, 6, 2048)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" in plan and "Join" not in plan


def test_undecodable_images_are_ok(spark):
    images = spark.createDataFrame([(1, None, None)], "id int, phash long, dhash long")
    index = spark.createDataFrame([(1, 2)], "phash long, dhash long")
    assert tuple(screen.near_duplicate_verdict(images, index).first()) == (1, "ok", 64, 64)
    assert tuple(screen.near_duplicate_verdict(images.fillna(1), index.limit(0)).first()) == (1, "ok", 64, 64)
    assert screen.near_duplicate_verdict(images.limit(0), index).count() == 0


def test_banding_selftest_misses_nothing(spark):
    row = screen.banding_selftest(spark, 2000).first()
    assert (row["trials"], row["missed"]) == (2000, 0)


def test_screen_plan_has_no_cross_product(spark, sf):
    df = screen.near_duplicate_verdict(bindings.candidates(spark, sf), bindings.forbidden(spark, sf))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_hot_band_key_is_cut_into_cells(spark):
    """A third of all keys in one band value: no cell of its grid holds more than a few times its bound."""
    hot = "cast(if(id % 3 = 0, (xxhash64(id) & -1024) | 5, xxhash64(id)) as bigint)"
    probes, pairs = (spark.range(n).selectExpr(f"{hot} as phash", "xxhash64(id, 1) as dhash") for n in (6000, 3000))
    grid = screen._grid(probes, pairs, 6, 100)
    assert grid.count() <= 25_000
    key = screen._slot_key(0, "phash", 0, 10)
    row = grid.where(F.col("_key") == spark.range(1).select(F.lit(5).cast("long").alias("phash")).select(key).scalar()).first()
    assert row["_rows"] >= 20 and row["_columns"] >= 10
    cells = (screen._band_rows(probes, 6).join(grid, "_key")
             .groupBy("_key", F.pmod(F.xxhash64("phash", "dhash"), F.col("_rows"))).count())
    assert cells.agg(F.max("count")).first()[0] <= 200


def test_unsigned_text_round_trip(spark):
    values = [0, 1, 2**63 - 1, 2**63, 2**64 - 1]
    df = spark.createDataFrame([(str(v),) for v in values], "t string").withColumn("h", hashing.from_unsigned(F.col("t")))
    assert [r["u"] for r in df.select(hashing.to_unsigned(F.col("h")).alias("u")).collect()] == [str(v) for v in values]


def test_build_needs_an_index_unless_told(spark, sf):
    with pytest.raises(ValueError, match="allow_unscreened"):
        ingest.screen(bindings.staged(spark, sf), None)
    kept, stats = ingest.screen(bindings.staged(spark, sf).drop("content"), None, allow_unscreened=True)
    assert stats.first()["accepted"] == kept.count() > 0


def test_index_build_refuses_short_or_failed_sets(spark):
    rows = [(f"coco2017/val2017/{i}.jpg", i * 7919, i * 104729, True, None) for i in range(20)]
    schema = "id string, phash long, dhash long, ok boolean, error string"
    good = spark.createDataFrame(rows, schema)
    assert build.build_index(good, "val2017", 20).count() == 20
    with pytest.raises(ValueError, match="expected 21"):
        build.build_index(good, "val2017", 21)
    broken = spark.createDataFrame(rows[1:] + [(rows[0][0], None, None, False, "x")], schema)
    with pytest.raises(ValueError, match="could not be hashed"):
        build.build_index(broken, "val2017", 20)
    assert build.build_index(broken, "val2017", 20, allowed_failures=1).count() == 19


# ── order, caps, paths ──────────────────────────────────────────────────────

@pytest.mark.parametrize("k", [1, 7, 50, 400, 5000])
def test_first_rows_equal_a_plain_ranking(spark, k):
    df = spark.range(2000).selectExpr("id", "id % 3 = 0 as g", "int(id / 100) as file", "id % 4 <> 1 as ok")
    got = {r["id"] for r in ordered.first_rows(df, ["g"], F.col("file"), ["id"], k).collect()}
    counted = {r["id"] for r in ordered.first_rows(df, ["g"], F.col("file"), ["id"], k, counted=F.col("ok")).collect()}
    plain, ahead = Counter(), Counter()
    want, want_counted = set(), set()
    for i in range(2000):
        g = i % 3 == 0
        if plain[g] < k:
            want.add(i)
        if ahead[g] < k:
            want_counted.add(i)
        plain[g] += 1
        ahead[g] += i % 4 != 1
    assert got == want and counted == want_counted


def test_cap_is_balanced_and_skipped_when_it_fits(spark):
    df = spark.range(1000).selectExpr("id", "int(id % 5 = 0) as label")
    kept = views.balanced_cap(df, 300).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in kept} == {0: 150, 1: 150}
    assert views.balanced_cap(df, 1000).count() == 1000 and views.balanced_cap(df, 0).count() == 1000


def test_sample_is_exact_and_seeded(spark):
    df = spark.range(500)
    first = {r["id"] for r in screen.seeded_sample(df, 37).collect()}
    assert len(first) == 37 and first == {r["id"] for r in screen.seeded_sample(df.repartition(9), 37).collect()}
    assert first != {r["id"] for r in screen.seeded_sample(df, 37, seed=1).collect()}


@pytest.mark.parametrize("text,expected", [("a b//c", "a_b_c"), ("__x__", "x"), ("///", "unknown"), ("  k-1.2 ", "k-1.2")])
def test_safe_part(spark, text, expected):
    assert spark.range(1).select(naming.safe_part(F.lit(text))).first()[0] == expected


def test_forbidden_paths(spark):
    paths = {"a/coco2017/val2017/1.jpg": True, "a\\coco2017\\val2017\\1.jpg": True, "x/DALLE/Advanced/1": True,
             "DALLE/Advanced/1": True, "x/Advanced/DALLE3/": True, "coco2017/train2017/1": False}
    df = spark.createDataFrame(list(paths.items()), "p string, want boolean")
    assert df.where(naming.is_forbidden_path(F.col("p")) != F.col("want")).count() == 0


def test_shard_keys(spark):
    df = spark.createDataFrame([("full/s-1.parquet#12",), ("ns/full/s.parquet#0",), ("full/a/b.parquet#1",), ("x/y.jpg",)], "p string")
    got = [tuple(r) for r in df.select(naming.shard_of(F.col("p")), naming.shard_row(F.col("p"))).collect()]
    assert got == [("full/s-1.parquet", 12), ("ns/full/s.parquet", 0), (None, None), (None, None)]


def test_canonical_plan_arithmetic(spark):
    rows = [(f"r{i}", sha(str(i)), w, h, ar, se, i % 2 == 0) for i, (w, h, ar, se) in enumerate(
        [(1000, 500, 1.0, 256), (500, 1000, 1.0, 256), (333, 777, 1.7, 100), (32, 32, 1.0, 32), (641, 427, 0.75, 90)])]
    df = spark.createDataFrame(rows, "raw_id string, raw_sha256 string, width int, height int, target_ar double, target_se int, arrived_jpeg boolean")
    for r in geometry.canonical_plan(df).collect():
        if r["width"] / r["height"] > r["target_ar"]:
            want = (max(1, round(r["height"] * r["target_ar"])), r["height"])
        else:
            want = (r["width"], max(1, round(r["width"] / r["target_ar"])))
        assert (r["crop_w"], r["crop_h"]) == want
        assert (r["crop_x"], r["crop_y"]) == ((r["width"] - want[0]) // 2, (r["height"] - want[1]) // 2)
        scale = r["target_se"] / min(want)
        assert (r["out_w"], r["out_h"]) == tuple(max(1, round(x * scale)) for x in want)
        assert r["generations"] == (1 if r["arrived_jpeg"] else 2) and 75 <= r["quality_1"] <= 96
        assert (r["quality_2"] is None) == r["arrived_jpeg"]


def test_seeded_draw_is_the_numpy_generator(spark):
    df = spark.createDataFrame([(sha(str(i)), "native") for i in range(50)], "raw_sha256 string, pool string")
    for r in geometry.draw_targets_seeded(df, {"native": 17}, seed=9).collect():
        rng = np.random.default_rng(9 ^ int(r["raw_sha256"][:16], 16))
        assert (r["ar_idx"], r["se_idx"]) == (rng.integers(0, 17), rng.integers(0, 17))


def test_validation_finds_missing_and_wrong_blobs(spark):
    manifest = spark.createDataFrame([("a", sha("1")), ("b", sha("2")), ("c", sha("3"))], "path string, sha256 string")
    blobs = spark.createDataFrame([("a", b"1"), ("b", b"x")], "path string, content binary")
    got = {(r["path"], r["problem"]) for r in validate.check_sample(manifest, blobs).collect()}
    assert got == {("b", "hash mismatch"), ("c", "missing")}


def test_manifest_merge_requires_columns(spark):
    with pytest.raises(ValueError, match="sha256"):
        ingest.merge_frames(spark.createDataFrame([("p", 1, "val")], "path string, label int, split string"))


def test_distinct_content_keeps_the_first(spark, sf):
    rows = bindings.staged(spark, sf).drop("content")
    kept = ingest.distinct_content(rows)
    assert kept.count() == rows.select("raw_sha256").distinct().count() < rows.count()


def test_bytes_stay_below_every_exchange(spark, tmp_path):
    """Bytes are hashed where they are read: no exchange lies under a node that still has them."""
    spark.range(100).selectExpr(
        "id as doc_id", "encode(string(id), 'utf-8') as payload", "'WildFake_GAN' as dataset", "'' as upstream_split", "0 as label",
        "'' as generator", "'f' as file", "id as row").write.parquet(str(tmp_path / "raw"))
    staged = spark.read.parquet(str(tmp_path / "raw")).withColumn("raw_sha256", hashing.sha(F.col("payload")))
    for df in (split.leakage(split.assign_split(staged)),
               ordered.first_rows(staged.select("doc_id", "raw_sha256", "label"), ["label"], F.substring("raw_sha256", 1, 3), ["raw_sha256"], 5)):
        lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        for i, line in enumerate(lines):
            if "payload" in line:
                below = [other for other in lines[i + 1:i + 1 + next((k for k, o in enumerate(lines[i + 1:]) if depth(o) <= depth(line)), len(lines))]]
                assert not any("Exchange" in other for other in below)
        assert any("payload" in line for line in lines)
