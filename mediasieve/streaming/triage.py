"""Structured Streaming forms of triage, dedup and the forbidden screen."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import screen, triage


def prediction_stream(spark: SparkSession, path: str, schema: str, max_files: int = 1000) -> DataFrame:
    """New prediction files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def triaged(stream: DataFrame, policy: triage.Policy) -> DataFrame:
    """Each arriving score with its decision: stateless, the same plan as in batch."""
    return triage.triage(stream, policy)[0]


def count_windows(stream: DataFrame, policy: triage.Policy, out: str, checkpoint: str, ts: str = "ts", window: str = "1 hour"):
    """Decision counts per tumbling window and batch, for ``window_counts``.

    Each micro-batch writes its own partial counts into a folder of its number, so a
    batch that is replayed overwrites what it wrote before. Nothing waits for a
    watermark: late events count whenever they come, and no state is kept.
    """
    def write(batch: DataFrame, number: int) -> None:
        rows = triage.triage(batch, policy)[0].groupBy(F.window(ts, window).alias("w"), "decision").agg(F.count(F.lit(1)).alias("n"))
        rows.select(F.col("w.start").alias("window_start"), "decision", "n").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return _by_batch(stream, write, checkpoint)


def window_counts(spark: SparkSession, out: str) -> DataFrame:
    """Counts of all events so far: the partial counts of all batches by window and decision."""
    parts = spark.read.schema("window_start timestamp, decision string, n long, batch long").parquet(out)
    return parts.groupBy("window_start", "decision").agg(F.sum("n").alias("n"))


def first_by_content(stream: DataFrame, content: str, ts: str = "ts", watermark: str = "1 hour") -> DataFrame:
    """One row per content hash; state is dropped once the watermark passes it."""
    keyed = stream.withColumn("sha256", hashing.sha(F.col(content))).withWatermark(ts, watermark)
    return keyed.dropDuplicatesWithinWatermark(["sha256"])


def first_of_session(stream: DataFrame, content: str, id_col: str, ts: str = "ts", gap: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """(id, sha256, ts) of each row whose content was not seen within ``gap`` before it.

    Copies prolong the wait: one comes out again only after ``gap`` without any. Arriving rows
    are folded to runs (first, last) per content hash before they are shuffled, so a content that
    makes up a third of the stream costs its task a row for each arriving batch and run. State is one
    time per content and is dropped by an event-time timer once the watermark has passed it
    by ``gap``. Of equal times the smallest id comes out; rows without a time, which no timer could end, drop out.
    """
    pause = pd.Timedelta(gap)
    rows = stream.where(F.col(ts).isNotNull()).select(
        F.coalesce(hashing.sha(F.col(content)), F.lit("")).alias("sha256"), F.col(ts).cast("timestamp").alias("first"), F.col(id_col).alias("id"))
    id_type = dict(rows.dtypes)["id"]
    runs = rows.mapInPandas(_runs(pause), f"sha256 string, first timestamp, id {id_type}, last timestamp")
    return runs.withWatermark("first", watermark).groupBy("sha256").applyInPandasWithState(
        _first_of_runs(pause), f"id {id_type}, sha256 string, ts timestamp", "last long", "append", "EventTimeTimeout")


def _runs(pause: pd.Timedelta):
    """Fold each arriving batch to runs of one content without a longer pause."""
    def fold(batches):
        for rows in batches:
            rows = rows.sort_values(["sha256", "first", "id"])
            opens = (rows["sha256"] != rows["sha256"].shift()) | (rows["first"] - rows["first"].shift() > pause)
            yield rows.groupby(opens.cumsum()).agg(sha256=("sha256", "first"), first=("first", "first"), id=("id", "first"), last=("first", "last"))

    return fold


def _first_of_runs(pause: pd.Timedelta):
    """A content's runs in plain numbers of microseconds: a content has few of them and there are many contents, so frames are only made of what comes out."""
    wait = pause.value // 1000

    def merge(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        runs = []
        for batch in batches:
            times = [batch[name].to_numpy().astype("datetime64[us]").astype("int64").tolist() for name in ("first", "last")]
            runs += zip(times[0], batch["id"].tolist(), times[1])
        runs.sort(key=lambda run: (run[0], run[1] is None, run[1]))
        last = state.get[0] if state.exists else None
        out = []
        for first, row_id, until in runs:
            if last is None or first > last + wait:
                out.append((row_id, first))
            last = until if last is None else max(last, until)
        state.update((last,))
        # local times stand for instants: the timer counts from the latest watermark at the earliest
        state.setTimeoutTimestamp(max((last + wait) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            ids, times = zip(*out)
            yield pd.DataFrame({"id": ids, "sha256": key[0], "ts": np.array(times, "datetime64[us]")})

    return merge


def screen_batches(stream: DataFrame, index: Callable[[], DataFrame], out: str, checkpoint: str, id_col: str = "id"):
    """Write verdicts batch by batch, against the index as it is when the batch starts.

    The index may have any size: each batch is screened as in batch mode. ``index``
    is asked anew for every batch, so an index replaced between two batches holds from the next
    one on. A batch that is replayed overwrites its own folder.
    """
    def write(batch: DataFrame, number: int) -> None:
        screen.near_duplicate_verdict(batch, index(), id_col=id_col).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return _by_batch(stream, write, checkpoint)


def _by_batch(stream: DataFrame, write, checkpoint: str):
    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append"):
    """Process everything that has arrived into Parquet and stop."""
    return (stream.writeStream.format("parquet").outputMode(mode).option("path", out)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
