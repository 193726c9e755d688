"""Readers and writers of manifests, shards, images, predictions, indexes and blobs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, naming
from ..operators import ingest
from ..operators.screen import distinct_index
from . import in_place

# Image suffixes of a directory scan.
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "webp", "bmp")


# ── manifests ───────────────────────────────────────────────────────────────

def read_manifest(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A manifest, or one split of it (partition pruned); an empty split is an error."""
    manifest = spark.read.parquet(path)
    if split is None:
        return manifest
    if split not in ("train", "val", "test"):
        raise ValueError(f"split must be train, val or test, got {split!r}")
    rows = manifest.where(F.col("split") == split)
    if not rows.take(1):
        raise ValueError(f"no rows for split {split!r} in {path}")
    return rows


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Manifest columns in order, partitioned by split."""
    ingest.to_manifest(manifest).write.mode("overwrite").partitionBy("split").parquet(path)


def expand_paths(spark: SparkSession, patterns, exclude: str | None = None) -> list[str]:
    """Sorted distinct manifest files of the glob patterns, without the output path."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = set()
    for pattern in patterns:
        path = jvm.org.apache.hadoop.fs.Path(pattern)
        statuses = path.getFileSystem(conf).globStatus(path)
        found.update(status.getPath().toString() for status in statuses or [])
    if exclude:
        target = jvm.org.apache.hadoop.fs.Path(exclude)
        found.discard(target.getFileSystem(conf).makeQualified(target).toString())
    if not found:
        raise ValueError(f"no manifests match {list(patterns)}")
    return sorted(found)


def read_manifest_parts(spark: SparkSession, patterns, exclude: str | None = None) -> list[DataFrame]:
    """CSV and Parquet manifest parts, one frame per format."""
    paths = expand_paths(spark, patterns, exclude)
    csv = [p for p in paths if p.lower().endswith(".csv")]
    parquet = [p for p in paths if p.lower().endswith((".parquet", ".pq"))]
    odd = sorted(set(paths) - set(csv) - set(parquet))
    if odd:
        raise ValueError(f"unsupported manifest files {odd}")
    # Files of one format may differ in optional columns: read each, then union by name.
    frames = [spark.read.csv(p, header=True) for p in csv]
    if parquet:
        frames.append(spark.read.option("mergeSchema", "true").parquet(*parquet))
    return frames


def merge_manifests(spark: SparkSession, patterns, exclude: str | None = None) -> DataFrame:
    """All parts as one manifest with the fixed columns."""
    return ingest.merge_frames(*read_manifest_parts(spark, patterns, exclude))


# ── image shards ────────────────────────────────────────────────────────────

def resolve_image_cell(df: DataFrame, root: str, image_col: str = "image", by_path: bool = False) -> DataFrame:
    """Add ``content``: the cell's bytes, or with ``by_path`` the bytes of the file it names.

    A relative path counts from the shard folder ``root``. Without ``by_path`` a cell
    that has no bytes fails the run. With it the files that such cells name are read in a
    map, each once for each cell: no other file is opened and no bytes are shuffled.
    """
    if dict(df.dtypes)[image_col] == "binary":
        return df.withColumn("content", F.col(image_col))
    inline, named = F.col(f"{image_col}.bytes"), F.col(f"{image_col}.path")
    lacking = F.raise_error(F.concat(F.lit("image cell without bytes, path "), F.coalesce(named, F.lit("NULL")))).cast("binary")
    if not by_path:
        return df.withColumn("content", F.coalesce(inline, lacking))
    full = F.when(named.startswith("/") | named.contains(":/"), named).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), named))
    resolved = in_place.read_files(df.where(inline.isNull()).withColumn("_file", full), "_file").drop("_file")
    return df.where(inline.isNotNull()).withColumn("content", inline).unionByName(resolved)


def read_image_shards(spark: SparkSession, root: str, registry: dict, dataset: str, by_path: bool = False) -> DataFrame:
    """Upstream shards of one dataset as raw rows, only the registry's columns read.

    The row index comes from the file itself, so ids do not depend on batching.
    """
    spec = next(d for d in registry["datasets"] if d["dataset"] == dataset)
    try:
        files, folder = spark.read.parquet(f"{root}/data/*.parquet"), f"{root}/data"
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        # no data folder: the shards lie in the root
        files, folder = spark.read.parquet(f"{root}/*.parquet"), root
    columns = [name for name in spec["columns"] if name in files.columns]
    if "image" not in columns or "label" not in columns:
        raise ValueError(f"shards of {dataset} must hold the columns image and label")
    rows = files.select(*columns, F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    raw_id = F.concat("file", F.lit(":"), F.col("row").cast("string"))
    if "img_id" in columns:
        raw_id = F.coalesce(F.col("img_id").cast("string"), raw_id)
    resolved = resolve_image_cell(rows, folder, by_path=by_path)
    return resolved.select(
        F.lit(dataset).alias("dataset"), F.lit("").alias("archive"), F.lit("").alias("member"),
        F.col("label").cast("int").alias("upstream_label"), naming.upstream_split(F.col("file")).alias("upstream_split"),
        "file", "row", raw_id.alias("raw_id"), hashing.sha(F.col("content")).alias("raw_sha256"), "content")


# ── packed shards and blobs ─────────────────────────────────────────────────

def read_packed_shards(spark: SparkSession, root: str) -> DataFrame:
    """Packed rows as (shard, row, image, sha256); ``shard`` is the path under the root."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(root)
    under = F.regexp_replace(F.col("_metadata.file_path"), "^file:(//)?", "")
    return rows.select(F.substring(under, F.lit(len(root.rstrip("/")) + 2), F.length(under)).alias("shard"),
                       F.col("_metadata.row_index").alias("row"), "image", "sha256")


def resolve_blobs(manifest: DataFrame, shards: DataFrame, loose: DataFrame | None = None) -> DataFrame:
    """Add ``content``: from the packed row the path names, or from the loose blob."""
    keyed = manifest.withColumn("_shard", naming.shard_of(F.col("path"))).withColumn("_row", naming.shard_row(F.col("path")))
    packed = keyed.where(F.col("_shard").isNotNull()).join(
        shards.select(F.col("shard").alias("_shard"), F.col("row").alias("_row"), F.col("image").alias("content")),
        ["_shard", "_row"], "left")
    out = packed.select(*manifest.columns, "content")
    if loose is not None:
        rest = keyed.where(F.col("_shard").isNull()).join(loose.select("path", "content"), "path", "left")
        out = out.unionByName(rest.select(*manifest.columns, "content"))
    return out


def resolve_in_place(manifest: DataFrame, root: str) -> DataFrame:
    """Add ``content``: the manifest alone is shuffled, bytes are read from packed shards and loose files under ``root``.

    A missing file, or a row that its shard does not have, fails the run.
    """
    base = F.lit(root.rstrip("/") + "/")
    shard, row = naming.shard_of(F.col("path")), naming.shard_row(F.col("path"))
    packed = manifest.withColumn("_file", F.concat(base, shard)).withColumn("_row", row).where(F.col("_file").isNotNull())
    loose = manifest.where(shard.isNull()).withColumn("_file", F.concat(base, "path"))
    return in_place.read_rows(packed, {"image": "content binary"}, "_file", "_row").drop("_file", "_row").unionByName(
        in_place.read_files(loose, "_file").drop("_file"))


def _rows_there(spark: SparkSession, path: str, *columns: str) -> DataFrame | None:
    """Key columns of a table, or None where it is not there yet."""
    try:
        return spark.read.parquet(path).select(*columns)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def unpack_shards(wanted: DataFrame, root: str, dest: str) -> None:
    """Append the wanted (shard, row) rows that ``dest`` lacks, with their bytes checked against the stored hash.

    Rows are chosen on keys, read in place and written by the task that read them, as one
    table with a ``shard`` column. A run that stopped is completed by the next, and a run
    with nothing to do writes nothing. A row that does not match fails the job before it commits.
    """
    keys = wanted.select("shard", "row").distinct()
    there = _rows_there(wanted.sparkSession, dest, "shard", "row")
    todo = keys if there is None else keys.join(there, ["shard", "row"], "left_anti")
    todo = todo.withColumn("_file", F.concat(F.lit(root.rstrip("/") + "/"), "shard"))
    if not todo.take(1):
        return
    rows = in_place.read_rows(todo, {"image": "image binary", "sha256": "sha256 string"}, "_file", "row").drop("_file")
    where = F.concat("shard", F.lit(" row "), F.col("row").cast("string"), F.lit(" does not match its sha256"))
    rows = rows.withColumn("image", F.when(hashing.sha(F.col("image")) == F.col("sha256"), F.col("image")).otherwise(F.raise_error(where).cast("binary")))
    rows.write.mode("append").parquet(dest)


def publish_blobs(spark: SparkSession, staged: str, dest: str) -> None:
    """Publish staged (path, sha256, content) rows once per path; what ``dest`` holds is never written again.

    The winner of a path is its least (file, row) of the staged table. It is chosen, and what is published is
    left out, on keys; the bytes are then read in place and appended by one job, which shows all of its rows or
    none. A publication that stopped is completed by the next run, and one without news writes nothing.
    """
    keys = spark.read.parquet(staged).select("path", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("_at"))
    winners = keys.where("path IS NOT NULL").groupBy("path").agg(F.min("_at").alias("_at"))
    there = _rows_there(spark, dest, "path")
    todo = (winners if there is None else winners.join(there, "path", "left_anti")).select("path", "_at.*")
    if not todo.take(1):
        return
    rows = in_place.read_rows(todo, {"sha256": "sha256 string", "content": "content binary"}).drop("file", "row")
    (rows.write.mode("append").option("parquet.bloom.filter.enabled#sha256", "true")
     .option("parquet.bloom.filter.enabled#path", "true").parquet(dest))


def materialize_shards(manifest: DataFrame, shards: DataFrame, dest: str, unpacked: DataFrame | None = None,
                       verify: bool = True) -> DataFrame:
    """Unpack shards not yet complete to a table partitioned by shard; returns what was pending."""
    pending = ingest.pending_shards(manifest, unpacked)
    todo = shards.join(pending.select("shard"), "shard", "left_semi")
    if verify:
        # Checked while writing, in the same pass; a bad row fails the job before it commits.
        where = F.concat("shard", F.lit(" row "), F.col("row").cast("string"), F.lit(" does not match its sha256"))
        todo = todo.withColumn("image", F.when(hashing.sha(F.col("image")) == F.col("sha256"), F.col("image"))
                               .otherwise(F.raise_error(where).cast("binary")))
    # Only the partitions written are replaced, so a stopped run resumes.
    (todo.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(dest))
    return pending


def write_blobs(canonical: DataFrame, path: str) -> None:
    """Canonical bytes once per path, as one Parquet table keyed by hash.

    Bytes cross one shuffle, for the write-once rule. Bloom filters on the hash and
    the path serve look-ups, so no folder per prefix and no second shuffle is needed.
    """
    rows = canonical.select("sha256", "path", "content").dropDuplicates(["path"])
    (rows.write.mode("overwrite").option("parquet.bloom.filter.enabled#sha256", "true")
     .option("parquet.bloom.filter.enabled#path", "true").parquet(path))


# ── image folders, predictions, indexes ─────────────────────────────────────

def scan_images(spark: SparkSession, root: str, path_style: str = "relative") -> DataFrame:
    """Image files under a folder: (image_path, length, content) in no order; sort at the sink."""
    pattern = rf"(?i)\.({'|'.join(IMAGE_SUFFIXES)})$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", "^file:(//)?", "")
    return files.where(F.col("path").rlike(pattern)).select(
        naming.spelled_path(path, root, path_style).alias("image_path"), "length", "content")


def check_predictions(rows: DataFrame, on_invalid: str = "fail") -> DataFrame:
    """Rows with a path and a score in [0, 1]; others fail the run, are split off, or drop."""
    valid = F.col("image_path").isNotNull() & F.col("pred").isNotNull() & F.col("pred").between(0.0, 1.0)
    valid = F.coalesce(valid, F.lit(False))
    if on_invalid == "reject":
        return rows.withColumn("valid", valid)
    if on_invalid == "drop":
        return rows.where(valid)
    checked = F.when(valid, F.col("pred")).otherwise(F.raise_error(F.concat(
        F.lit("invalid prediction for "), F.coalesce("image_path", F.lit("a row without image_path")))))
    return rows.withColumn("pred", checked)


def read_predictions(spark: SparkSession, path: str, on_invalid: str = "fail") -> DataFrame:
    """A prediction file: a JSON array of {image_path, pred}."""
    return check_predictions(spark.read.schema("image_path string, pred double").json(path, multiLine=True), on_invalid)


def write_index(index: DataFrame, path: str) -> None:
    distinct_index(index).write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("phash", "dhash")
