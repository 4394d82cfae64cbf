"""The catalog: volumes, files and fingerprints.

``volumes``, ``files`` and ``prints`` derive a catalog from the driver's
document tables, one file for each document. ``scan`` builds the same columns
from a directory of any file system that Spark reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsight.functions import images, simhash
from kinsight.functions.names import extension
from kinsight.storage import stored


#: 100 ns ticks since 1601 of the first file, and of a second.
FIRST_TICK, SECOND = 132_500_000_000_000_000, 10_000_000
#: Volumes that are not attached.
OFFLINE = (7, 19)
PROBE_BYTES = 65_536


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty volumes at most, as there are sources; a fixed dimension."""
    ids = _table(spark, sf_dir, "documents").select(F.regexp_extract("source", "[0-9]+", 0).cast("int").alias("volume_id")).distinct()
    name = F.lpad(F.col("volume_id").cast("string"), 2, "0")
    return ids.select(
        "volume_id",
        F.concat(F.lit("{vol-"), name, F.lit("}")).alias("volume_guid"),
        F.when(F.col("volume_id") % 6 == 1, "Google Drive").otherwise(F.concat(F.lit("disk"), name)).alias("label"),
        F.when(F.col("volume_id") % 4 == 0, "exFAT").otherwise("NTFS").alias("file_system"),
        (F.col("volume_id").cast("bigint") * 500_000_000).alias("total_bytes"),
        F.element_at(F.array(*map(F.lit, ("Ssd", "Hdd", "Remote"))), F.col("volume_id") % 3 + 1).alias("storage_kind"),
        F.when(F.col("volume_id") != 5, F.concat(F.chr(F.col("volume_id") + 65), F.lit(":\\"))).alias("last_mount_point"),
        (~F.col("volume_id").isin(*OFFLINE)).alias("attached"),
    )


def files(spark: SparkSession, sf_dir: str, text: bool = False) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l"), "quality", "toxic")
    events = _table(spark, sf_dir, "events").select(F.col("event_id").alias("e"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    k = F.col("doc_id")
    ext = F.when(F.col("lang") == "en", ".jpg").when(F.col("lang") == "fr", ".png").when(F.col("lang") == "de", ".nef").otherwise(".txt")
    six = F.lpad(k.cast("string"), 6, "0")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    stem = (
        F.when(k % 6 == 0, F.concat(F.lit("IMG_"), six))
        .when(k % 6 == 1, F.concat(F.lit("holiday "), k.cast("string"), F.lit(" - Copy")))
        .when(k % 6 == 2, F.concat(F.lit("IMG_2021"), two(1 + k % 12), two(1 + k % 28), F.lit("_172347")))
        .when(k % 6 == 3, F.concat(F.lit("_MG_"), six))
        .when(k % 6 == 4, F.concat(F.lit("photo ("), (k % 7).cast("string"), F.lit(")")))
        .otherwise("wedding")
    )
    folder = F.when(k % 7 == 0, "backup").when(k % 11 == 0, "WhatsApp").otherwise(F.concat(F.lit("set"), (k % 10).cast("string")))
    n = F.col("n_chars")
    own = d.join(labels, k == F.col("l"), "left").join(events, k == F.col("e"), "left")
    own = own.withColumn("name", F.concat(stem, ext))
    made = own.select(
        k.alias("file_key"),
        F.regexp_extract("source", "[0-9]+", 0).cast("int").alias("volume_id"),
        F.concat_ws("\\", "lang", "source", folder, "name").alias("rel_path"),
        "name",
        ext.alias("ext"),
        n.alias("size"),
        (F.lit(FIRST_TICK) + k * SECOND).alias("mtime"),
        (F.lit(FIRST_TICK) + k * SECOND).alias("ctime"),
        F.when(k % 50 == 0, 2).when(k % 77 == 0, 4096).otherwise(32).cast("bigint").alias("attributes"),
        F.when(k % 9 != 0, k - k % 2).alias("file_id_low"),
        F.when(k % 13 == 0, 1).otherwise(2).cast("bigint").alias("last_scan_id"),
        (k % 29 != 0).alias("present"),
        F.md5(F.concat(F.left("text", F.lit(64)), F.right("text", F.lit(64)), n.cast("string"))).alias("partial_hash"),
        F.when(k % 31 != 0, F.md5("text")).alias("content_hash"),
        F.when(k % 17 == 0, n + 1).otherwise(n).alias("hashed_size"),
        (F.lit(FIRST_TICK) + k * SECOND).alias("hashed_mtime"),
        F.md5(F.array_join(F.slice(F.split(F.lower("text"), " "), 1, 12), " ")).alias("pixel_hash"),
        (100 * (1 + k % 8)).cast("int").alias("img_width"),
        (75 * (1 + k % 8)).cast("int").alias("img_height"),
        F.when(k % 41 == 0, 2).otherwise(1).alias("decode_state"),
        F.col("l").isNotNull().alias("has_exif"),
        F.coalesce(F.col("quality") * 10 + F.col("toxic"), F.lit(0)).cast("int").alias("exif_tags"),
        F.when(k % 4 != 0, F.floor(F.col("us") / 1_000_000)).cast("bigint").alias("date_taken"),
        F.when(k % 8 == 1, F.col("us") % 1_000_000).cast("int").alias("sub_sec"),
        F.when(ext == ".jpg", 50 + k % 50).cast("int").alias("jpeg_quality"),
        F.when(k % 3 == 0, 3).otherwise(4).alias("meta_state"),
        *(["text"] if text else []),
    )
    return made


def prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_key, dhash and phash (simhashes of words and word pairs), thumb16 (letter shares in thousandths), thumb_mean and contrast.

    Fingerprints are made once and kept, as a catalog keeps them.
    """
    texts = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("file_key"), F.lower("text").alias("text"), F.col("n_chars").cast("bigint").alias("n_chars"))
    found = stored(simhash.voted(texts), "votes")
    hashes = found.groupBy("file_key").agg(simhash.simhash(0).alias("dhash"), simhash.simhash(simhash.BITS).alias("phash"))
    made = hashes.join(found.select("file_key", "thumb16"), "file_key")
    total = F.aggregate("thumb16", F.lit(0).cast("bigint"), lambda a, v: a + v)
    return stored(made.withColumn("thumb_mean", total / F.size("thumb16")).withColumn("contrast", images.spread(F.col("thumb16"))), "prints")


def scan(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """rel_path, name, ext, size, mtime (ticks) of every file below a directory; with content, its bytes, probe and full hash, too.

    Without content the columns of it are not read, so a scan costs a listing.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.replace(F.regexp_replace(F.col("path"), r"^(?:file:)?/*" + root.strip("/").removeprefix("file:").strip("/") + "/", ""), F.lit("/"), F.lit("\\"))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    made = found.select(
        rel.alias("rel_path"),
        name.alias("name"),
        extension(name).alias("ext"),
        F.col("length").alias("size"),
        (F.unix_micros("modificationTime") * 10 + 116_444_736_000_000_000).alias("mtime"),
        *(["content"] if content else []),
    )
    return made.withColumns({"partial_hash": probe_hash(F.col("content"), F.col("size")), "content_hash": F.md5("content")}) if content else made


def probe_hash(content: Column, size: Column) -> Column:
    """Of small files all bytes; of larger ones the first and last PROBE_BYTES and the size."""
    ends = F.concat(F.substring(content, 1, PROBE_BYTES), F.substring(content, -PROBE_BYTES, PROBE_BYTES), size.cast("string").cast("binary"))
    return F.xxhash64(F.when(size <= 2 * PROBE_BYTES, content).otherwise(ends))
