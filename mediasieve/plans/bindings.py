"""Bind the library's tables to a star-schema folder, so every operator has input.

Each function reads one or two Parquet tables and derives a library table with
column expressions only (rasters use one Arrow job). Nothing is sampled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import registry
from ..functions import hashing
from ..operators import jobs, views
from ..session import spread

# Which upstream collection each of the twenty document sources stands for:
# (source number, variant = doc_id % 2, dataset, archive, member folder).
LAYOUT = (
    [(n, v, "SID_Set", "", "") for n in range(0, 4) for v in (0, 1)]
    + [(n, v, "CIFAKE", "", "") for n in range(4, 8) for v in (0, 1)]
    + [
        (8, 0, "WildFake_GAN", "Images/GAN_based.zip", "GAN_based/Advanced/DF-GAN/"),
        (8, 1, "WildFake_GAN", "Images/GAN_based.zip", "GAN_based/Typical/BigGAN/"),
        (9, 0, "WildFake_GAN", "Images/GAN_based.zip", "GAN_based/Advanced/GigaGAN/"),
        (9, 1, "WildFake_GAN", "Images/GAN_based.zip", "GAN_based/Unlisted/other/"),
        (10, 0, "WildFake_GAN", "Images/GAN_based.zip", "GAN_based/Typical/styleGAN/"),
        (10, 1, "WildFake_GAN", "Images/GAN_based.zip", "__MACOSX/styleGAN/"),
        (11, 0, "WildFake_GAN", "Images/Real/ffhq.zip", "ffhq/"),
        (11, 1, "WildFake_GAN", "Images/Real/celebahq.zip", "celebahq/"),
        (12, 0, "WildFake_GAN", "Images/Real/coco.zip", "coco/coco2017/val2017/"),
        (12, 1, "WildFake_GAN", "Images/Real/coco.zip", "coco/coco2017/train2017/"),
        (13, 0, "WildFake_Diffusion", "Images/Diffusion_based/ADM.zip", "ADM/"),
        (13, 1, "WildFake_Diffusion", "Images/Diffusion_based/VQDM.zip", "VQDM/"),
        (14, 0, "WildFake_Diffusion", "Images/Diffusion_based/DALLE.zip", "DALLE/Advanced/"),
        (14, 1, "WildFake_Diffusion", "Images/Diffusion_based/DALLE.zip", "DALLE/Typical/"),
        (15, 0, "WildFake_Diffusion", "Images/Diffusion_based/Imagen.zip", "Imagen/"),
        (15, 1, "WildFake_Diffusion", "Images/Real/church.zip", "church/"),
        (16, 0, "WildFake_Diffusion", "Images/Diffusion_based/Midjourney/Advanced/part_1.zip", ""),
        (16, 1, "WildFake_Diffusion", "Images/Diffusion_based/SD/originalSD/Advanced/part_2.zip", "SDXL/"),
        (17, 0, "WildFake_Other", "Images/Other_based.zip", "Other_based/Advanced/MAGE/"),
        (17, 1, "WildFake_Other", "Images/Other_based.zip", "Other_based/Advanced/MAE/"),
        (18, 0, "WildFake_Other", "Images/Other_based.zip", "Other_based/Typical/VQGAN/"),
        (18, 1, "WildFake_Other", "Images/Other_based.zip", "Other_based/Typical/VQVAE/"),
        (19, 0, "WildFake_Other", "Images/Real/imagenet.zip", "imagenet/"),
        (19, 1, "WildFake_Other", "Images/Real/coco.zip", "coco/coco2017/train2017/"),
    ]
)

# Which generator each order priority stands for: two held out, two trained, one unlisted.
PRIORITY_GENERATOR = {
    "1-URGENT": "WildFake/GigaGAN",
    "2-HIGH": "WildFake/Imagen",
    "3-MEDIUM": "WildFake/SDXL",
    "4-NOT SPECIFIED": "WildFake/VQGAN",
    "5-LOW": "Unlisted/Generator",
}

TEMPERATURE = 0.8

# Tables whose rows are hashed or turned into pixels by the bindings.
WORKED_TABLES = ("orders", "documents", "embeddings", "lineitem", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table; a scan of fewer tasks than cores is spread before heavy work."""
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(scan) if name in WORKED_TABLES else scan


def uploads(spark, sf_dir) -> DataFrame:
    """``documents`` as raw upstream rows; ``content`` is the image payload."""
    layout = F.broadcast(spark.createDataFrame(
        list(LAYOUT), "_n int, _v int, dataset string, archive string, folder string"))
    docs = table(spark, sf_dir, "documents")
    keyed = docs.select(
        "doc_id", "lang", F.col("text").alias("content"),
        F.substring("source", 4, 4).cast("int").alias("_n"), (F.col("doc_id") % 2).cast("int").alias("_v"))
    member = F.concat("folder", "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".jpg"))
    digest = hashing.sha(F.col("content"))
    is_archive = F.col("archive") != ""
    return keyed.join(layout, ["_n", "_v"]).select(
        "doc_id", "dataset", "archive",
        F.when(is_archive, member).otherwise("").alias("member"),
        F.when(is_archive, F.concat("archive", F.lit(":"), member))
        .otherwise(F.concat(F.lit("src"), F.col("_n"), F.lit("/"), F.col("doc_id"))).alias("raw_id"),
        F.when(~is_archive, (F.col("doc_id") % 3).cast("int")).alias("upstream_label"),
        F.when(is_archive, "").when(F.col("doc_id") % 5 != 0, "train")
        .when(F.col("dataset") == "SID_Set", "validation").otherwise("test").alias("upstream_split"),
        F.concat(F.lit("shard-"), F.lpad(F.col("_n").cast("string"), 5, "0"), F.lit(".parquet")).alias("file"),
        F.col("doc_id").alias("row"),
        digest.alias("raw_sha256"),
        F.conv(F.substring(digest, 1, 16), 16, -10).cast("bigint").alias("phash"),
        F.conv(F.substring(digest, 17, 16), 16, -10).cast("bigint").alias("dhash"),
        F.when(F.col("dataset") == "CIFAKE", F.lit(32))
        .otherwise((64 + hashing.hex_number(digest, 33, 6) % 961).cast("int")).alias("width"),
        F.when(F.col("dataset") == "CIFAKE", F.lit(32))
        .otherwise((64 + hashing.hex_number(digest, 39, 6) % 961).cast("int")).alias("height"),
        (hashing.hex_number(digest, 45, 2) % 2 == 0).alias("arrived_jpeg"),
        "content",
    )


def staged(spark, sf_dir) -> DataFrame:
    """Uploads mapped through the registry."""
    from ..operators import ingest

    return ingest.map_sources(uploads(spark, sf_dir), registry.sources(spark))


def toxic_index(spark, sf_dir) -> DataFrame:
    """Hash pairs of documents labelled toxic, some bits flipped by a rule."""
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    docs = table(spark, sf_dir, "documents").join(toxic, "doc_id", "left_semi")
    digest = hashing.sha(F.col("text"))
    mask = hashing.one_bit(F.col("doc_id") % 8) - 1
    return docs.select(
        F.conv(F.substring(digest, 1, 16), 16, -10).cast("bigint").bitwiseXOR(mask).alias("phash"),
        F.conv(F.substring(digest, 17, 16), 16, -10).cast("bigint").bitwiseXOR(mask).alias("dhash"),
    ).distinct()


def scored(spark, sf_dir) -> DataFrame:
    """``orders`` as scored images: id, label, logit and the slicing attributes."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    label = (F.col("o_orderstatus") == "F").cast("int")
    generators = F.create_map(*[F.lit(x) for pair in PRIORITY_GENERATOR.items() for x in pair])
    key = F.col("o_orderkey").cast("string")
    base = orders.join(customer, orders.o_custkey == customer.c_custkey, "left").select(
        F.col("o_orderkey").alias("id"), label.alias("label"),
        F.when(label == 1, generators[F.col("o_orderpriority")]).otherwise("").alias("generator"),
        F.coalesce("c_mktsegment", F.lit("unknown")).alias("content"),
        F.when(hashing.hex_number(hashing.sha(F.concat(F.lit("split:"), key)), 1, 8) % 2 == 0, "val")
        .otherwise("test").alias("split"),
        F.round(4 * (hashing.uniform(key) - 0.5) + 1.2 * (2 * label - 1), 3).alias("logit"))
    fake = F.col("label") == 1
    source = (F.when(F.col("content") == "BUILDING",
                     F.when(fake, "CIFAKE/SD-1.4").otherwise("CIFAKE/CIFAR-10"))
              .when(F.col("content") == "MACHINERY",
                    F.when(fake, "WildFake/GALIP").otherwise("WildFake/real_coco"))
              .otherwise(F.when(fake, "SID_Set/FLUX").otherwise("SID_Set/OpenImagesV7")))
    real_source = (F.when(~fake, "").when(F.col("content") == "BUILDING", "CIFAR-10")
                   .when(F.col("content") == "MACHINERY", "CC12M+COCO").otherwise("Flickr30k+COCO"))
    return base.withColumn("source", source).withColumn("real_source", real_source)


def scored_views(spark, sf_dir, salt: str = "") -> DataFrame:
    """Scored images under clean and the 14 degradations, logits drifting per view."""
    return drifted(views.fan_out(scored(spark, sf_dir)), salt)


def drifted(fanned: DataFrame, salt: str = "") -> DataFrame:
    noise = hashing.uniform(F.concat(F.lit(salt), F.col("id").cast("string"), F.lit(":"), F.col("view")))
    moved = F.round(F.col("logit") * (1 - 0.03 * F.col("view_no")) + 0.8 * (noise - 0.5), 3)
    return fanned.withColumn("logit", F.when(F.col("view_no") == 0, F.col("logit")).otherwise(moved))


def branch_views(spark, sf_dir, branch: str) -> DataFrame:
    """Logit bundle of a branch: A as scored, B informative, C pure noise."""
    rows = views.fan_out(scored(spark, sf_dir))
    noise = hashing.uniform(F.concat(F.lit(f"{branch}:"), F.col("id").cast("string"), F.lit(":"), F.col("view")))
    if branch == "A":
        rows = drifted(rows)
    elif branch == "B":
        rows = rows.withColumn("logit", F.round(
            3 * (noise - 0.5) + (1.0 - 0.02 * F.col("view_no")) * (2 * F.col("label") - 1), 3))
    elif branch == "C":
        rows = rows.withColumn("logit", F.round(4 * (noise - 0.5), 3))
    else:
        raise ValueError(f"unknown branch {branch!r}")
    return rows.select("id", "label", "view", "logit", F.lit(branch).alias("branch"), "split")


def hashed_vectors(vectors: DataFrame) -> DataFrame:
    """Hashes of each embedding read as an 8x8 grey raster."""
    return vectors.select(
        F.col("vec_id").alias("id"),
        jobs.phash_from_pixels(F.col("embedding"), 8).alias("phash"),
        jobs.dhash_from_pixels(F.col("embedding"), 8, 8).alias("dhash"))


def forbidden(spark, sf_dir) -> DataFrame:
    """Hash pairs of embedding class 0, the class that stands for forbidden content."""
    marked = table(spark, sf_dir, "embeddings").where("label = 0")
    return hashed_vectors(marked)


def candidates(spark, sf_dir) -> DataFrame:
    """All embeddings as images, and a copy of every forbidden one with planted
    bit flips (0 to 12 bits chosen by hash)."""
    every = hashed_vectors(table(spark, sf_dir, "embeddings"))
    digest = hashing.sha(F.concat(F.lit("flip:"), F.col("id").cast("string")))
    mask = hashing.flip_mask(digest, hashing.hex_number(digest, 1, 2) % 13, 12)
    planted = forbidden(spark, sf_dir).select(
        (F.col("id") + 1_000_000_000).alias("id"),
        F.col("phash").bitwiseXOR(mask).alias("phash"), F.col("dhash").bitwiseXOR(mask).alias("dhash"))
    return every.unionByName(planted)


def order_hashes(spark, sf_dir) -> DataFrame:
    """One hash pair per order, in 1 of 3 the same pair: a hot group of copies."""
    digest = hashing.sha(F.when(F.col("o_orderkey") % 3 == 0, F.lit("blank"))
                         .otherwise(F.col("o_orderkey").cast("string")))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.conv(F.substring(digest, 1, 16), 16, -10).cast("bigint").alias("phash"),
        F.conv(F.substring(digest, 17, 16), 16, -10).cast("bigint").alias("dhash"))


def customer_index(spark, sf_dir) -> DataFrame:
    """Forbidden pairs derived from customers: order hashes with 0 to 7 low bits flipped."""
    digest = hashing.sha((F.col("c_custkey") * 7 + 1).cast("string"))
    mask = hashing.one_bit(F.col("c_custkey") % 8) - 1
    return table(spark, sf_dir, "customer").select(
        F.conv(F.substring(digest, 1, 16), 16, -10).cast("bigint").bitwiseXOR(mask).alias("phash"),
        F.conv(F.substring(digest, 17, 16), 16, -10).cast("bigint").bitwiseXOR(mask).alias("dhash"))


def _numbered_hashes(frame: DataFrame, text, flips) -> DataFrame:
    digest, mask = hashing.sha(text), hashing.one_bit(flips) - 1
    return frame.withColumn("phash", F.conv(F.substring(digest, 1, 16), 16, -10).cast("bigint").bitwiseXOR(mask)).withColumn(
        "dhash", F.conv(F.substring(digest, 17, 16), 16, -10).cast("bigint").bitwiseXOR(mask))


def customer_hashes(spark, sf_dir) -> DataFrame:
    """One hash pair per customer, made of its number."""
    return _numbered_hashes(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), F.col("id").cast("string"), F.lit(0))


def line_index(spark, sf_dir) -> DataFrame:
    """A pair per line item of its order number, line number - 1 low bits flipped; line 1 is a customer's own pair."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return _numbered_hashes(lines, F.col("l_orderkey").cast("string"), F.col("l_linenumber") - 1).select("phash", "dhash")


def predictions(spark, sf_dir) -> DataFrame:
    """``events`` as a score feed."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("image_path"),
        F.least(F.col("value") / 500, F.lit(1.0)).alias("pred"), F.col("ts").cast("timestamp").alias("ts"))


def rasters(spark, sf_dir) -> DataFrame:
    """Embeddings as 64x48 RGB rasters, in the layout of Spark's image source."""
    return jobs.rasters_from_vectors(table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding"), width=64, height=48)


def encoded(rasters: DataFrame) -> DataFrame:
    """Rasters with ``content``: a JPEG header of id % 4 quantisation tables made from hashes of the id, then the pixels.

    A raster without tables has no header at all.
    """
    key = F.col("id").cast("string")
    half = lambda side, table: hashing.sha(F.concat(F.lit(f"q{side}:"), key, F.lit(f":{table}")))
    tables = [F.when(F.col("id") % 4 > k, F.concat(F.lit(f"FFDB00430{k}"), half(0, k), half(1, k))).otherwise("") for k in range(3)]
    header = F.when(F.col("id") % 4 > 0, F.concat(F.lit("FFD8"), *tables, F.lit("FFD9"))).otherwise("")
    return rasters.withColumn("content", F.concat(F.unhex(header), F.col("raster")))


def probe_features(spark, sf_dir) -> DataFrame:
    """``lineitem`` as file statistics: 9 acquisition and 5 content features."""
    rows = table(spark, sf_dir, "lineitem")
    width = F.col("l_quantity") * 8 + 32
    height = (F.col("l_partkey") % 97) * 4 + 32
    size = F.col("l_extendedprice")
    key = F.concat_ws(":", *[F.col(name).cast("string") for name in
                             ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")])
    return rows.select(
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        key.alias("id"),
        width.alias("width"), height.cast("double").alias("height"),
        (width * height).alias("pixels"), (width / height).alias("aspect_ratio"),
        F.least(width, height.cast("double")).alias("short_edge"),
        (F.col("l_tax") * 100).alias("jpeg_quality"), (F.col("l_suppkey") % 3).cast("double").alias("n_quant_tables"),
        (F.col("l_tax") * 100).alias("q_mean"), (F.col("l_discount") * 100).alias("q_std"),
        size.alias("file_size"), (size / (width * height)).alias("bytes_per_pixel"),
        (F.col("l_discount") * size).alias("dct_energy"),
        ((F.col("l_suppkey") % 11) / 10.0).alias("dct_hf_ratio"),
        (F.col("l_linenumber") + F.when(F.col("l_returnflag") == "R", 0.5).otherwise(0.0)).alias("dct_kurtosis"))


def staged_rasters(spark, sf_dir, rasters: DataFrame) -> DataFrame:
    """Embeddings as staged upstream rows: hashes, sizes and registry columns, no bytes.

    The embedding's class picks the upstream label of one labelled dataset.
    """
    base = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("_class"))
    hashes = hashed_vectors(table(spark, sf_dir, "embeddings"))
    sized = rasters.select("id", "width", "height", hashing.sha(F.col("raster")).alias("raw_sha256"))
    rows = base.join(hashes, "id").join(sized, "id").select(
        "id", F.col("id").alias("doc_id"), "phash", "dhash", "width", "height", "raw_sha256",
        F.lit("SID_Set").alias("dataset"), F.lit("").alias("archive"), F.lit("").alias("member"),
        (F.col("_class") % 3).cast("int").alias("upstream_label"),
        F.when(F.col("_class") < 7, "train").otherwise("validation").alias("upstream_split"),
        F.lit("rasters.parquet").alias("file"), F.col("id").alias("row"),
        F.concat(F.lit("rasters/"), F.col("id").cast("string")).alias("raw_id"),
        (F.col("_class") % 2 == 0).alias("arrived_jpeg"))
    from ..operators import ingest

    return ingest.map_labels(rows, registry.sources(spark))
