"""Bytes are read where they lie, after every decision on keys; streams of sessions."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from mediasieve.sources import in_place, tables
from mediasieve.streaming import triage as streams


@pytest.fixture
def packed(spark, tmp_path):
    """Two shard files of several row groups: (root, {(shard, row): bytes})."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    import hashlib

    (tmp_path / "full").mkdir()
    held = {}
    for name, count in (("a", 700), ("b", 30)):
        cells = [None if i == 7 else (f"{name}{i}" * (1 + i % 5)).encode() for i in range(count)]
        digests = [hashlib.sha256(c or b"").hexdigest() for c in cells]
        pq.write_table(pa.table({"other": range(count), "image": pa.array(cells, pa.binary()), "sha256": digests}),
                       str(tmp_path / "full" / f"{name}.parquet"), row_group_size=300)
        held |= {(f"full/{name}.parquet", i): c for i, c in enumerate(cells)}
    return str(tmp_path), held


def keys_of(spark, root, pairs):
    return spark.createDataFrame([(i, f"{root}/{s}", r) for i, (s, r) in enumerate(pairs)], "id int, file string, row long")


def test_rows_are_read_in_place(spark, packed, monkeypatch):
    root, held = packed
    pairs = [*held, *[("full/a.parquet", 5)] * 900, ("full/a.parquet", None), (None, 3)]      # one row asked for very often
    keys = spark.createDataFrame([(i, s and f"file:{root}/{s}", r) for i, (s, r) in enumerate(pairs)], "id int, file string, row long")
    got = {r["id"]: r["content"] for r in in_place.read_rows(keys, {"image": "content binary"}).collect()}
    assert got == {i: held[p] for i, p in enumerate(pairs[:-2])}
    assert in_place.read_rows(keys.limit(0), {"image": "content binary"}).count() == 0


def test_bounded_batches_cover_every_row():
    import numpy as np

    sizes = np.array([5, 9 << 20, 9 << 20, 40 << 20, 0, 1])
    assert list(in_place._bounded(sizes)) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert list(in_place._bounded(np.array([], dtype=int))) == []


@pytest.mark.parametrize("pair", [("full/a.parquet", 700), ("full/a.parquet", -1), ("full/gone.parquet", 0)])
def test_a_row_that_is_not_there_fails(spark, packed, pair):
    with pytest.raises(PySparkException, match="asked for|gone"):
        in_place.read_rows(keys_of(spark, packed[0], [pair]), {"image": "content binary"}).collect()


def test_no_bytes_below_an_exchange(spark, packed, tmp_path):
    root, held = packed
    (tmp_path / "loose").mkdir()
    (tmp_path / "loose" / "1.jpg").write_bytes(b"loose")
    manifest = spark.createDataFrame([(f"{s}#{r}",) for s, r in held] + [("loose/1.jpg",)], "path string")
    df = tables.resolve_in_place(manifest, root)
    assert {r["path"]: r["content"] for r in df.collect()} == {f"{s}#{r}": c for (s, r), c in held.items()} | {"loose/1.jpg": b"loose"}
    plan = df._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanges and plan.index("MapInArrow") < plan.index("Exchange")
    assert not any("content" in line or "image" in line for line in exchanges)
    with pytest.raises(PySparkException, match="missing image file"):
        tables.resolve_in_place(spark.createDataFrame([("loose/2.jpg",)], "path string"), root).collect()


def test_unpacking_is_completed_and_checked(spark, packed, tmp_path):
    root, held = packed
    wanted = spark.createDataFrame([k for k, c in held.items() if c is not None], "shard string, row long")
    dest = str(tmp_path / "out")
    tables.unpack_shards(wanted.where("row < 20"), root, dest)
    tables.unpack_shards(wanted.union(wanted), root, dest)
    files = sorted(p.name for p in (tmp_path / "out").iterdir())
    tables.unpack_shards(wanted, root, dest)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == files          # nothing left to write
    got = [((r["shard"], r["row"]), bytes(r["image"])) for r in spark.read.parquet(dest).collect()]
    assert len(got) == len(held) - 2 and dict(got) == {k: c for k, c in held.items() if c is not None}
    # a null image does not match its hash: the job fails and shows no row
    with pytest.raises(PySparkException, match="does not match"):
        tables.unpack_shards(spark.createDataFrame(list(held), "shard string, row long"), root, str(tmp_path / "bad"))
    assert tables._rows_there(spark, str(tmp_path / "bad"), "row") is None


def test_blobs_are_published_once(spark, tmp_path):
    staged, dest = str(tmp_path / "staged"), str(tmp_path / "blobs")
    rows = spark.range(200).select((F.col("id") % 150).cast("string").alias("path"), F.lit("h").alias("sha256"),
                                   F.encode((F.col("id") % 150).cast("string"), "UTF-8").alias("content"))
    rows.where("path < '5'").write.parquet(staged)
    tables.publish_blobs(spark, staged, dest)
    first = {p.name for p in (tmp_path / "blobs").iterdir()}
    rows.write.mode("append").parquet(staged)
    tables.publish_blobs(spark, staged, dest)
    second = {p.name for p in (tmp_path / "blobs").iterdir()}
    tables.publish_blobs(spark, staged, dest)
    assert first < second == {p.name for p in (tmp_path / "blobs").iterdir()}
    got = [(r["path"], r["content"].decode()) for r in spark.read.parquet(dest).collect()]
    assert len(got) == 150 and dict(got) == {str(i): str(i) for i in range(150)}


def test_sessions_across_batches_and_late_copies(spark, tmp_path):
    at = lambda minutes: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)
    path, schema = str(tmp_path / "in"), "id long, content string, ts timestamp"
    arrive = lambda rows: spark.createDataFrame([(i, c, m if m is None else at(m)) for i, c, m in rows], schema).coalesce(1).write.mode("append").parquet(path)

    def run():
        stream = spark.readStream.schema(schema).parquet(path)
        found = streams.first_of_session(stream, "content", "id", gap="60 minutes", watermark="30 minutes")
        streams.run_available(found, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    arrive([(1, "a", 0), (2, "a", 50), (3, "a", 105), (4, "b", 10), (5, None, 0), (6, None, 1), (7, "c", None), (9, "d", 0), (8, "d", 0)])
    assert run() == [1, 4, 5, 8]                       # copies prolong the wait, equal times give the smallest id
    arrive([(10, "a", 160), (11, "a", 90), (12, "b", 200)])
    assert run() == [1, 4, 5, 8, 12]                   # within an hour of the last copy of the batch before
    arrive([(13, "z", 5000)])
    run()
    arrive([(14, "a", 5001), (15, "z", 5002)])         # the state of a has been dropped by its timer
    assert run() == [1, 4, 5, 8, 12, 13, 14]


def test_hot_content_is_folded_before_the_shuffle(spark):
    import pandas as pd

    rows = pd.DataFrame({"sha256": ["x"] * 500 + ["y"], "first": pd.to_datetime(["2024-01-01"] * 501) + pd.to_timedelta(range(501), "s"), "id": range(501)})
    (folded,) = streams._runs(pd.Timedelta("1 hour"))([rows])
    assert folded["id"].tolist() == [0, 500] and folded["last"].iloc[0] == rows["first"].iloc[499]


def test_archive_members_through_registry_screen_and_duplicates(spark, tmp_path):
    """Equal members leave but for the first, by their place in the archive; prefixes without a source are not inflated."""
    import zipfile

    from mediasieve import registry
    from mediasieve.operators import ingest, split
    from mediasieve.sources import archives

    rows = registry.source_rows()
    names = {r[6] for r in rows if r[0] == "WildFake_GAN" and r[6]}
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        with zipfile.ZipFile(tmp_path / name, "w") as archive:
            for member, content in (("GAN_based/Typical/BigGAN/2.jpg", b"same"), ("GAN_based/Typical/BigGAN/1.jpg", b"same"),
                                    ("ffhq/1.jpg", b"face"), ("nothing/1.jpg", b"lost"), ("coco/coco2017/val2017/1.jpg", b"forbidden")):
                if member.startswith("GAN") == (name == "Images/GAN_based.zip"):
                    archive.writestr(member, content)
    raw = archives.read_archives(spark, f"file:{tmp_path}", rows, "WildFake_GAN").withColumns(
        {"doc_id": F.xxhash64("raw_id"), "phash": F.xxhash64("content"), "dhash": F.xxhash64("content", F.lit(1))}).drop("content")
    mapped = ingest.map_sources(raw, registry.sources(spark))
    kept, stats = ingest.screen(mapped, spark.createDataFrame([(0, 0)], "phash long, dhash long"), limit_per_dataset=5)
    first = split.assign_split(ingest.distinct_content(kept)).collect()
    got = [(r["member"], r["row"]) for r in first if r["archive"] == "Images/GAN_based.zip"]
    assert got == [("GAN_based/Typical/BigGAN/1.jpg", 0)]
    assert not {r["member"] for r in first} & {"nothing/1.jpg", "coco/coco2017/val2017/1.jpg"}
    assert stats.first()["accepted"] == kept.count() <= 5


def test_a_prolonged_session_makes_no_frame():
    """A content whose rows all follow within the gap changes its state and hands on nothing."""
    import numpy as np
    import pandas as pd

    class State:
        hasTimedOut, exists, get = False, True, (60_000_000,)

        def update(self, value):
            self.get = value

        def getCurrentWatermarkMs(self):
            return 0

        def setTimeoutTimestamp(self, due):
            self.due = due

    state, pause = State(), pd.Timedelta("60 seconds")
    at = lambda *seconds: pd.to_datetime(np.array(seconds) * 1_000_000_000)
    batch = lambda first, ids, last: pd.DataFrame({"first": at(*first), "id": ids, "last": at(*last)})
    merge = streams._first_of_runs(pause)
    assert list(merge(("x",), iter([batch([120, 90], [2, 1], [130, 95])]), state)) == []
    assert state.get == (130_000_000,) and state.due == 190_001
    (out,) = merge(("x",), iter([batch([191], [5], [192]), batch([400, 191], [6, 4], [400, 191])]), state)
    assert out["id"].tolist() == [4, 6] and out["ts"].tolist() == list(at(191, 400)) and state.get == (400_000_000,)
