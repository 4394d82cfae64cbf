"""Statistics by volume, extension and folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsight.functions.names import folder_at

MIB = 1024 * 1024


def by_volume(files: DataFrame, volumes: DataFrame) -> DataFrame:
    """Every volume, without files, too: files are counted first, then joined to the dimension."""
    counts = files.groupBy("volume_id").agg(
        F.count_if("present").alias("files"),
        F.coalesce(F.sum(F.when(F.col("present"), F.col("size"))), F.lit(0)).alias("bytes"),
        F.count_if(~F.col("present")).alias("missing"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return F.broadcast(volumes).join(counts, "volume_id", "left").select(
        "volume_id", F.coalesce("last_mount_point", "volume_guid").alias("volume"), zero("files"), zero("bytes"), zero("missing")
    )


def by_extension(files: DataFrame, top: int = 12) -> DataFrame:
    """The extensions with most bytes; files without one are "(none)"."""
    found = files.where("present").groupBy(F.coalesce("ext", F.lit("(none)")).alias("ext")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    return found.orderBy(F.desc("bytes"), "ext").limit(top)


def folders(files: DataFrame, depth: int = 3) -> DataFrame:
    """Redundant files and bytes by volume and folder.

    Of equal contents all but the one with the least key are redundant (exact,
    provable); of equal pictures likewise (picture), unless exact already. The
    least keys come from combinable aggregations, so a hot hash is no window.
    """
    here = files.where("present")
    least = lambda c: here.where(F.col(c).isNotNull()).groupBy(c).agg(F.min("file_key").alias(f"__{c}"))
    ranked = here.join(least("content_hash"), "content_hash", "left").join(least("pixel_hash"), "pixel_hash", "left")
    exact = F.coalesce(F.col("file_key") > F.col("__content_hash"), F.lit(False))
    picture = ~exact & F.coalesce(F.col("file_key") > F.col("__pixel_hash"), F.lit(False))
    folder = folder_at(F.col("rel_path"), depth)
    found = ranked.groupBy("volume_id", F.lower(folder).alias("folder_key")).agg(
        F.min(folder).alias("folder"),
        F.count(F.lit(1)).alias("files"),
        F.sum("size").alias("bytes"),
        F.count_if(exact).alias("exact_files"),
        F.coalesce(F.sum(F.when(exact, F.col("size"))), F.lit(0)).alias("exact_bytes"),
        F.count_if(picture).alias("picture_files"),
        F.coalesce(F.sum(F.when(picture, F.col("size"))), F.lit(0)).alias("picture_bytes"),
    )
    total = F.col("exact_bytes") + F.col("picture_bytes")
    return found.select(
        "*",
        total.alias("reclaimable"),
        F.when(total == 0, 1.0).otherwise(F.col("exact_bytes") / F.when(total != 0, total)).alias("provable_share"),
        F.when(F.col("files") == 0, 0.0).otherwise((F.col("exact_files") + F.col("picture_files")) / F.col("files")).alias("redundant_share"),
    )


def top_folders(found: DataFrame, top: int = 25) -> DataFrame:
    return found.where("reclaimable > 0").orderBy(F.desc("reclaimable"), "volume_id", "folder_key").limit(top)


def safest_folder(found: DataFrame, share: float = 0.9, least_bytes: int = 100 * MIB) -> DataFrame:
    """The folder with most provable bytes among those nearly all provable."""
    return found.where((F.col("provable_share") >= share) & (F.col("exact_bytes") > least_bytes)).orderBy(F.desc("exact_bytes"), "volume_id", "folder_key").limit(1)
