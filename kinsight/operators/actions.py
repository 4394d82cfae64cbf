"""Dry runs over plans and the actions log: what applying, undoing, purging, linking and merging would do.

No file is touched. What exists now is a listing (path, size, content_hash,
pixel_hash); verdicts are columns of joins against it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinsight.functions.names import is_inside

RETENTION_DAYS = 14
JPEG = (".jpg", ".jpeg", ".jpe", ".jfif")


def verified(kind: Column, keeper: Column, victim: Column, planned_pixels: Column) -> Column:
    """Null if the relation of the kind still holds between two listed files, else why not."""
    same = lambda a, b: F.coalesce(a == b, F.lit(False))
    changed = (F.coalesce(planned_pixels, F.lit("")) != "") & ~same(F.lower(victim["pixel_hash"]), F.lower(planned_pixels))
    return (
        F.when(kind == "ExactBytes", F.when(~same(keeper["content_hash"], victim["content_hash"]), "bytes differ"))
        .when(kind == "IdenticalPicture", F.when(~same(keeper["pixel_hash"], victim["pixel_hash"]), "pixels differ"))
        .when(
            kind == "ReviewedByHuman",
            F.when(keeper["pixel_hash"].isNull() | victim["pixel_hash"].isNull(), "could not re-decode").when(changed, "the file changed since it was reviewed"),
        )
        .otherwise("unknown group kind")
    )


def _listed(listing: DataFrame, key: str, name: str) -> DataFrame:
    return listing.select(F.col("file_key").alias(key), F.struct("content_hash", "pixel_hash", "size").alias(name))


def apply_dry_run(plan: DataFrame, listing: DataFrame) -> DataFrame:
    """Every quarantine row of a plan with its outcome: would move, or why not."""
    keepers = plan.where("action = 'Keep'").select(F.col("file_key").alias("kept_file_key"), F.lit(True).alias("known")).distinct()
    rows = plan.where("action = 'Quarantine'").join(keepers, "kept_file_key", "left")
    rows = rows.join(_listed(listing, "file_key", "victim"), "file_key", "left").join(_listed(listing, "kept_file_key", "keeper"), "kept_file_key", "left")
    why = verified(F.col("kind"), F.col("keeper"), F.col("victim"), F.col("pixel_hash"))
    outcome = (
        F.when(F.col("known").isNull(), "no keeper recorded")
        .when(F.col("victim").isNull(), "gone since the scan")
        .when(F.col("keeper").isNull(), "keeper missing")
        .when(why.isNotNull(), F.concat(F.lit("verification failed: "), why))
        .otherwise("would move")
    )
    return rows.select("file_key", "kept_file_key", "kind", outcome.alias("outcome"), F.when(outcome == "would move", F.col("size")).otherwise(0).alias("bytes_freed"))


def current_state(events: DataFrame) -> DataFrame:
    """The last state of every action of an append-only log (action_id, seq, state, ...)."""
    return events.groupBy("action_id").agg(F.max_by(F.struct(*[c for c in events.columns if c != "action_id"]), "seq").alias("e")).select("action_id", "e.*")


def undo_dry_run(actions: DataFrame, volumes: DataFrame, paths: DataFrame, batch: str) -> DataFrame:
    """Every done action of a batch: would restore, or why not. paths lists what exists (path)."""
    done = actions.where((F.col("batch_id") == batch) & (F.col("state") == "done"))
    mounts = volumes.where("attached and last_mount_point is not null").select(F.lower("volume_guid").alias("g"), "last_mount_point")
    at = done.join(F.broadcast(mounts), F.lower("origin_volume") == F.col("g"), "left").withColumn("target", F.concat("last_mount_point", "origin_rel"))
    here = paths.select(F.lower("path").alias("p")).distinct()
    at = at.join(here.withColumnRenamed("p", "d"), F.lower("destination") == F.col("d"), "left").join(here.withColumnRenamed("p", "t"), F.lower("target") == F.col("t"), "left")
    outcome = (
        F.when(F.col("last_mount_point").isNull(), "volume not attached")
        .when(F.col("d").isNull(), "quarantined file is gone")
        .when(F.col("t").isNotNull(), "original path is occupied")
        .otherwise("would restore")
    )
    return at.select("action_id", "file_key", outcome.alias("outcome"))


def hardlink_eligibility(plan: DataFrame, files: DataFrame, volumes: DataFrame) -> DataFrame:
    """Every quarantine row: could it become a link to its keeper, or why not."""
    facts = files.join(F.broadcast(volumes.select("volume_id", "volume_guid", "file_system")), "volume_id").select(
        "file_key", F.struct(F.lower("volume_guid").alias("guid"), "file_id_low", "file_system", "present").alias("f")
    )
    rows = plan.where("action = 'Quarantine'").join(facts.withColumnRenamed("f", "dup"), "file_key", "left")
    rows = rows.join(facts.select(F.col("file_key").alias("kept_file_key"), F.col("f").alias("keep")), "kept_file_key", "left")
    outcome = (
        F.when(F.col("keep").isNull() | F.col("dup").isNull(), "no keeper recorded")
        .when(F.col("dup.guid") != F.col("keep.guid"), "different volumes")
        .when(~F.col("keep.present"), "keeper missing")
        .when(~F.col("dup.present"), "gone since the scan")
        .when(F.col("keep.file_id_low").isNull(), "no file ids")
        .when(F.col("keep.file_id_low") == F.col("dup.file_id_low"), "already the same file")
        .when(~F.lower("dup.file_system").isin("ntfs", "refs"), "file system has no hardlinks")
        .otherwise("eligible")
    )
    return rows.select("file_key", "kept_file_key", outcome.alias("outcome"))


def merge_candidates(plan: DataFrame) -> DataFrame:
    """Groups with an undated JPEG keeper and the dated loser of most tags, the first one of several."""
    low = F.lower("rel_path")
    jpeg = low.endswith(JPEG[0]) | low.endswith(JPEG[1]) | low.endswith(JPEG[2]) | low.endswith(JPEG[3])
    keepers = plan.where((F.col("action") == "Keep") & jpeg & F.col("date_taken").isNull()).select("group_key", F.col("file_key").alias("keeper"))
    donors = plan.where("action = 'Quarantine' and date_taken is not null and exif_tags > 0")
    best = donors.groupBy("group_key").agg(F.min_by(F.struct("file_key", "date_taken", "exif_tags"), F.struct(-F.col("exif_tags"), F.col("file_key"))).alias("b"))
    return keepers.join(best, "group_key").select("group_key", "keeper", F.col("b.file_key").alias("donor"), F.col("b.date_taken").alias("donor_date"), F.col("b.exif_tags").alias("donor_tags"))


def batches(actions: DataFrame) -> DataFrame:
    return actions.where("state = 'done'").groupBy("batch_id").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.min("acted_utc").alias("started"))


def history(actions: DataFrame, paths: DataFrame, now: str, days: int = RETENTION_DAYS, top: int = 20) -> DataFrame:
    """The last batches with their age in whole hours, whether they may be purged, and how many files are missing."""
    here = paths.select(F.lower("path").alias("p")).distinct()
    done = actions.where("state = 'done'").join(here, F.lower("destination") == F.col("p"), "left")
    missing = done.groupBy("batch_id").agg(F.count_if(F.col("p").isNull()).alias("missing"))
    age = F.timestamp_diff("HOUR", F.col("started"), F.lit(now).cast("timestamp_ntz"))
    found = batches(actions).join(missing, "batch_id").withColumn("age_hours", age)
    found = found.withColumn("status", F.when(F.col("age_hours") >= days * 24, "ripe").otherwise("kept"))
    return found.orderBy(F.desc("batch_id")).limit(top)


def purge_dry_run(actions: DataFrame, listing: DataFrame, batch: str, root: str, now: str, days: int = RETENTION_DAYS) -> DataFrame:
    """Every done action of a batch: would delete, skipped, or refused; nothing of a batch that is not ripe, and nothing outside the root. listing: path, size."""
    done = actions.where((F.col("batch_id") == batch) & (F.col("state") == "done"))
    started = done.groupBy().agg(F.min("acted_utc").alias("started"))
    here = listing.select(F.lower("path").alias("p"), F.col("size").alias("actual"))
    at = done.join(F.broadcast(started)).join(here, F.lower("destination") == F.col("p"), "left")
    outcome = (
        F.when(F.timestamp_diff("HOUR", F.col("started"), F.lit(now).cast("timestamp_ntz")) < days * 24, "refused: not ripe")
        .when(~is_inside(F.col("destination"), F.lit(root)), "refused: not inside")
        .when(F.col("p").isNull(), "skipped: gone")
        .when(F.col("actual") != F.col("size"), "refused: size changed")
        .otherwise("would delete")
    )
    return at.select("action_id", outcome.alias("outcome"), F.when(outcome == "would delete", F.col("actual")).otherwise(0).alias("bytes_freed"))


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """The last decision on each cluster key."""
    return decisions.groupBy("cluster_key").agg(F.max_by(F.struct("keeper_file_key", "state", "decided_utc"), F.struct("decided_utc", "keeper_file_key")).alias("d")).select("cluster_key", "d.*")


def review_restore(clusters: DataFrame, decisions: DataFrame) -> DataFrame:
    """Clusters (cluster_key, members) with the decision on them, if its keeper is still a member."""
    last = latest_decisions(decisions).select("cluster_key", F.col("keeper_file_key").alias("k"), F.col("state").alias("s"))
    both = clusters.join(last, "cluster_key", "left")
    holds = F.coalesce(F.array_contains("members", F.col("k")), F.lit(False))
    return both.select("cluster_key", F.size("members").alias("n_members"), F.when(holds, F.col("k")).alias("keeper_file_key"), F.when(holds, F.col("s")).otherwise("open").alias("state"))


def review_queue(plan: DataFrame) -> DataFrame:
    """Groups in the order of review: one picture is accepted unseen; of the rest those whose keeper has less metadata come first, then by gain."""
    keeper = plan.where("action = 'Keep'").select("group_key", F.col("exif_tags").alias("kt"), F.col("date_taken").alias("kd"))
    joined = plan.join(keeper, "group_key")
    poorer = (F.col("exif_tags") > F.col("kt")) | (F.col("date_taken").isNotNull() & F.col("kd").isNull())
    found = joined.groupBy("group_key").agg(
        F.countDistinct("pixel_hash").alias("pictures"),
        F.bool_or(poorer).alias("conflict"),
        F.sum(F.when(F.col("action") == "Quarantine", F.col("size")).otherwise(0)).alias("reclaimable"),
        F.count(F.lit(1)).alias("files"),
    )
    return found.withColumn("queue", F.when(F.col("pictures") == 1, "accepted").otherwise("review")).orderBy("queue", F.desc("conflict"), F.desc("reclaimable"), "group_key")


def ordinals(plan: DataFrame) -> DataFrame:
    """The place of each file in its group's grid: the keeper first, then by pixels."""
    pixels = F.col("img_width").cast("bigint") * F.col("img_height")
    order = Window.partitionBy("group_key").orderBy(F.desc(F.col("action") == "Keep"), F.desc(pixels), "file_key")
    return plan.select("group_key", "file_key", F.row_number().over(order).alias("ordinal"))


def best_cells(plan: DataFrame) -> DataFrame:
    """Which of a group's files has the most pixels, tags or quality; none is marked where all agree."""
    values = {"pixels": F.col("img_width").cast("bigint") * F.col("img_height"), "tags": F.col("exif_tags").cast("bigint"), "quality": F.coalesce("jpeg_quality", F.lit(0)).cast("bigint")}
    own = plan.select("group_key", "file_key", *[v.alias(k) for k, v in values.items()])
    bounds = own.groupBy("group_key").agg(*[f(k).alias(f"{n}_{k}") for k in values for n, f in (("lo", F.min), ("hi", F.max))])
    return own.join(bounds, "group_key").select(
        "group_key", "file_key", *[((F.col(k) == F.col(f"hi_{k}")) & (F.col(f"lo_{k}") < F.col(f"hi_{k}"))).alias(f"best_{k}") for k in values]
    )
