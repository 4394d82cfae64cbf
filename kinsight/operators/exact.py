"""Exact duplicates: the cascade of size, probe and content hash, groups, cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROBE_BOUND = 131_072


def physical_key() -> Column:
    """One value for all names of one physical file: its file id on its volume, or its path."""
    by_id = F.concat_ws(":", F.lit("id"), F.col("volume_id").cast("string"), F.col("file_id_low").cast("string"))
    by_path = F.concat_ws(":", F.lit("path"), F.col("volume_id").cast("string"), F.lower("rel_path"))
    return F.when(F.col("file_id_low").isNotNull(), by_id).otherwise(by_path)


def colliding(files: DataFrame, *keys: str) -> DataFrame:
    """Files whose keys another file has, too: a partial aggregation and a semi-join, so a hot key is no group of rows anywhere."""
    often = files.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(*keys)
    return files.join(often, list(keys), "left_semi")


def cascade(files: DataFrame) -> DataFrame:
    """Files that collide by size, then by size and probe."""
    return colliding(colliding(files, "size"), "size", "partial_hash")


def groups(files: DataFrame, volumes: DataFrame, min_copies: int = 2) -> DataFrame:
    """A row for each (size, content_hash) of at least min_copies physical copies; files without a hash are in none."""
    hashed = cascade(files.where("present and content_hash is not null"))
    dimension = F.broadcast(volumes.select("volume_id", "attached"))
    found = (
        hashed.join(dimension, "volume_id")
        .groupBy("size", "content_hash")
        .agg(
            F.count(F.lit(1)).alias("entries"),
            F.countDistinct(physical_key()).alias("copies"),
            F.bool_or(~F.col("attached")).alias("touches_offline"),
            F.min("file_key").alias("first_key"),
        )
        .where(F.col("copies") >= min_copies)
    )
    return found.withColumn("hardlinked", F.col("entries") - F.col("copies")).withColumn("reclaimable", F.col("size") * (F.col("copies") - 1))


def members(files: DataFrame, found: DataFrame) -> DataFrame:
    """Every file of the groups, with the group's hash: the listing of duplicates."""
    return files.where("present").join(found.select("size", "content_hash", "reclaimable"), ["size", "content_hash"])


def summary(found: DataFrame, min_size: int = 0) -> DataFrame:
    return found.where(F.col("size") >= min_size).agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("redundant"),
        F.coalesce(F.sum("reclaimable"), F.lit(0)).alias("reclaimable"),
        F.coalesce(F.sum("hardlinked"), F.lit(0)).alias("hardlinked"),
        F.count_if("touches_offline").alias("offline_groups"),
    )


def cascade_cost(files: DataFrame) -> DataFrame:
    """What each stage of the cascade reads: files and bytes that collide by size, and the bytes of their probes."""
    by_size = files.where("present").groupBy("size").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.sum(F.least(F.col("size"), F.lit(PROBE_BOUND))).alias("probe")
    )
    some = F.col("n") > 1
    total = lambda c, test: F.coalesce(F.sum(F.when(test, F.col(c))), F.lit(0))
    return by_size.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("files"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        F.count_if(some).alias("size_groups"),
        total("n", some).alias("candidates"),
        total("bytes", some).alias("candidate_bytes"),
        total("probe", some).alias("probe_bytes"),
    )


def unhashed(files: DataFrame) -> DataFrame:
    """How many files collide by size and have no content hash yet."""
    return colliding(files.where("present"), "size").agg(F.count_if(F.col("content_hash").isNull()).alias("unhashed"))
