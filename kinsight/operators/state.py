"""What runs write back: hashes, fingerprints, metadata, the log of actions, scans; and the summaries that read it.

A write-back is a left join of the catalog with a run's output, so a catalog is
a value and a run that is repeated gives the same one. The log of actions and of
scans is appended to; the present state is the last event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinsight.functions import metadata

#: States that an action may go to (fixed values).
MOVES = (("planned", "done"), ("planned", "failed"), ("done", "undone"), ("done", "purged"))
#: Days that quarantined files are kept, by default.
RETENTION_DAYS = 14


def _given(table: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row a key, as a struct beside a mark that it is there; of repeated keys the greatest."""
    return table.groupBy(F.col(key).alias("given_key")).agg(F.max(F.struct(*columns)).alias("given"))


def write_probes(files: DataFrame, probed: DataFrame) -> DataFrame:
    """files after the probe stage; probed: file_key, partial_hash, content_hash, size, mtime. A content hash that the stage did not make stays as it was.

    It stays even where the file changed since: the cascade compares files of
    one size and probe hash only, and ``changed`` files are hashed anew.
    """
    both = files.join(_given(probed, "file_key", "partial_hash", "content_hash", "size", "mtime"), F.col("file_key") == F.col("given_key"), "left")
    there, of = F.col("given").isNotNull(), lambda c: F.col(f"given.{c}")
    new = {
        "partial_hash": F.when(there, of("partial_hash")).otherwise(F.col("partial_hash")),
        "content_hash": F.coalesce(of("content_hash"), F.col("content_hash")),
        "hashed_size": F.when(there, of("size")).otherwise(F.col("hashed_size")),
        "hashed_mtime": F.when(there, of("mtime")).otherwise(F.col("hashed_mtime")),
    }
    return both.select(*[new.get(c, F.col(c)).alias(c) for c in files.columns])


def write_hashes(files: DataFrame, hashed: DataFrame) -> DataFrame:
    """files after the full stage; hashed: file_key, content_hash. All else stays."""
    both = files.join(_given(hashed, "file_key", "content_hash"), F.col("file_key") == F.col("given_key"), "left")
    new = F.when(F.col("given").isNotNull(), F.col("given.content_hash")).otherwise(F.col("content_hash"))
    return both.select(*[(new if c == "content_hash" else F.col(c)).alias(c) for c in files.columns])


def write_fingerprints(files: DataFrame, decoded: DataFrame, failed: DataFrame) -> DataFrame:
    """files with the pictures' facts and decode_state 1; those that failed (file_key) get decode_state 2 and keep what they had. decoded: file_key, pixel_hash, img_width, img_height."""
    facts = ("pixel_hash", "img_width", "img_height")
    both = files.join(_given(decoded, "file_key", *facts), F.col("file_key") == F.col("given_key"), "left")
    both = both.join(failed.select(F.col("file_key").alias("failed_key")).distinct(), F.col("file_key") == F.col("failed_key"), "left")
    there = F.col("given").isNotNull()
    new = {c: F.when(there, F.col(f"given.{c}")).otherwise(F.col(c)) for c in facts}
    new["decode_state"] = F.when(there, 1).when(F.col("failed_key").isNotNull(), 2).otherwise(F.col("decode_state"))
    return both.select(*[new.get(c, F.col(c)).alias(c) for c in files.columns])


def write_metadata(files: DataFrame, embedded: DataFrame, sidecars: DataFrame) -> DataFrame:
    """files with the best capture time, the number of tags, and meta_state as read. Both: file_key, date_taken, exif_tags; what is embedded goes before a sidecar.

    A file that neither has is left as it was.
    """
    sides = _given(sidecars, "file_key", "date_taken", "exif_tags").select(F.col("given_key").alias("side_key"), F.col("given").alias("side"))
    both = files.join(_given(embedded, "file_key", "date_taken", "exif_tags"), F.col("file_key") == F.col("given_key"), "left").join(sides, F.col("file_key") == F.col("side_key"), "left")
    there = F.col("given").isNotNull() | F.col("side").isNotNull()
    new = {
        "date_taken": F.when(there, F.coalesce("given.date_taken", "side.date_taken")).otherwise(F.col("date_taken")),
        "exif_tags": F.when(there, F.coalesce("given.exif_tags", "side.exif_tags", F.lit(0))).otherwise(F.col("exif_tags")),
        "has_exif": F.when(F.col("given").isNotNull(), F.lit(True)).otherwise(F.col("has_exif")),
        "meta_state": F.when(there, metadata.META_STATE).otherwise(F.col("meta_state")),
    }
    return both.select(*[new.get(c, F.col(c)).alias(c) for c in files.columns])


def find_sidecars(files: DataFrame, readable: DataFrame) -> DataFrame:
    """(file_key, sidecar_key, place): of each picture, the first of its candidate names that the volume has and that yields data. readable: file_key of such files."""
    wanted = files.select("file_key", "volume_id", F.posexplode(metadata.sidecar_names(F.col("rel_path"))).alias("place", "path"))
    there = files.join(readable.select("file_key").distinct(), "file_key", "left_semi").select("volume_id", F.lower("rel_path").alias("at"), F.col("file_key").alias("sidecar_key"))
    met = wanted.withColumn("at", F.lower("path")).join(there, ["volume_id", "at"]).where("file_key <> sidecar_key")
    return met.groupBy("file_key").agg(F.min(F.struct("place", "sidecar_key")).alias("first")).select("file_key", "first.sidecar_key", "first.place")


def planned_actions(plan: DataFrame, batch: str, next_id: int) -> DataFrame:
    """Log rows, state planned, of the files of a plan that go; numbered from next_id within range partitions, in order of file_key."""
    from kinsight.storage import stored

    goes = plan.where("action = 'Quarantine'").select("file_key", "kept_file_key", "size")
    goes = goes.repartitionByRange("file_key").withColumn("p", F.spark_partition_id())
    goes = stored(goes.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy("file_key"))), "planned")  # both uses see the same partitions
    sizes = goes.groupBy("p").agg(F.count(F.lit(1)).alias("n")).agg(F.collect_list(F.struct("p", "n")).alias("sizes"))
    before = F.aggregate(F.filter("sizes", lambda s: s["p"] < F.col("p")), F.lit(0).cast("bigint"), lambda a, s: a + s["n"])
    number = (F.lit(next_id) + before + F.col("r") - 1).cast("bigint")
    return goes.join(F.broadcast(sizes)).select(number.alias("action_id"), F.lit(batch).alias("batch_id"), "file_key", "kept_file_key", "size", F.lit("planned").alias("state"))


def checked_moves(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """(action_id, was, state, verdict) of wanted moves (action_id, state), against the last state in the log (action_id, seq, state)."""
    last = log.groupBy("action_id").agg(F.max_by("state", "seq").alias("was"))
    allowed = F.lit(False)
    for was, state in MOVES:
        allowed = allowed | ((F.col("was") == was) & (F.col("state") == state))
    verdict = F.when(F.col("was").isNull(), "unknown action").when(allowed, "moved").otherwise("refused")
    return wanted.join(last, "action_id", "left").select("action_id", "was", "state", verdict.alias("verdict"))


def present_after(files: DataFrame, log: DataFrame) -> DataFrame:
    """files with ``present`` as the log (file_key, seq, state) leaves it: moved files are gone, undone ones are back."""
    last = log.where(F.col("state").isin("done", "undone")).groupBy(F.col("file_key").alias("log_key")).agg(F.max_by("state", "seq").alias("last"))
    both = files.join(last, F.col("file_key") == F.col("log_key"), "left")
    now = F.when(F.col("last") == "done", False).when(F.col("last") == "undone", True).otherwise(F.col("present"))
    return both.select(*[(now if c == "present" else F.col(c)).alias(c) for c in files.columns])


def open_scans(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(volume_id, root, scan_id, verdict) of the scans to begin (volume_id, root, resume): the latest running one goes on, or is superseded by a new one.

    runs: scan_id, volume_id, root, status.
    """
    last = runs.where("status = 'running'").groupBy("volume_id", "root").agg(F.max("scan_id").alias("scan_id"))
    both = wanted.join(last, ["volume_id", "root"], "left")
    verdict = F.when(F.col("scan_id").isNull(), "new").when(F.col("resume"), "resumed").otherwise("superseded")
    return both.select("volume_id", "root", "scan_id", verdict.alias("verdict"))


def reset_verdict(log: DataFrame) -> DataFrame:
    """Whether a catalog may be set aside: not while a file of any batch is still in quarantine. One row: verdict, batches, files."""
    held = log.where("state = 'done'").agg(F.countDistinct("batch_id").alias("batches"), F.count(F.lit(1)).alias("files"))
    return held.select(F.when(F.col("files") > 0, "refused: files are in quarantine").otherwise("may be reset").alias("verdict"), "batches", "files")


def run_counters(files: DataFrame) -> DataFrame:
    """What the stages have left: one row of counts over present files."""
    there = F.col("present")
    count = lambda c: F.count_if(there & F.coalesce(c, F.lit(False)))
    return files.agg(
        count(F.lit(True)).alias("present"),
        count(F.col("partial_hash").isNotNull()).alias("probed"),
        count(F.col("content_hash").isNotNull()).alias("hashed"),
        count((F.col("hashed_size") != F.col("size")) | (F.col("hashed_mtime") != F.col("mtime"))).alias("stale"),
        count(F.col("decode_state") == 1).alias("decoded"),
        count(F.col("decode_state") == 2).alias("failed"),
        count(F.col("meta_state") == metadata.META_STATE).alias("with_metadata"),
    )


def similar_summary(metrics: DataFrame) -> DataFrame:
    """One row over cluster_metrics: clusters, those of one picture, files beyond the first, copies that differ in metadata only, bytes."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return metrics.agg(
        F.count(F.lit(1)).alias("clusters"), F.count_if("pixel_identical").alias("identical"), total(F.col("files") - 1).alias("redundant"), total("metadata_only").alias("metadata_only"), total("reclaimable").alias("reclaimable")
    )


def similar_listing(members: DataFrame, metrics: DataFrame, rows: DataFrame) -> DataFrame:
    """A row a file of a cluster, as the listing writes them: identical where the cluster is one picture, else near."""
    kinds = metrics.select("cluster", F.when(F.col("pixel_identical"), "identical").otherwise("near").alias("kind"))
    return members.join(kinds, "cluster").join(rows.select("file_key", "volume_id", "rel_path", "size", "img_width", "img_height", "pixel_hash"), "file_key")


def review_totals(decisions: DataFrame, metrics: DataFrame) -> DataFrame:
    """Confirmed clusters and the bytes they free. decisions: cluster, state, one row a cluster."""
    confirmed = decisions.where("state = 'confirmed'").select("cluster")
    return metrics.join(confirmed, "cluster", "left_semi").agg(F.count(F.lit(1)).alias("confirmed"), F.coalesce(F.sum("reclaimable"), F.lit(0)).cast("bigint").alias("reclaimable"))


def review_export(plan: DataFrame, decisions: DataFrame) -> DataFrame:
    """Plan rows of confirmed groups (group_key, state, keeper_file_key): the keeper that was decided on stays, all others go."""
    chosen = decisions.where("state = 'confirmed'").select("group_key", F.col("keeper_file_key").alias("chosen"))
    keeps = F.col("file_key") == F.col("chosen")
    return plan.join(chosen, "group_key").select("group_key", "file_key", F.when(keeps, "Keep").otherwise("Quarantine").alias("action"), F.when(~keeps, F.col("chosen")).alias("kept_file_key"), "size")


def absorb_roots(roots: DataFrame) -> DataFrame:
    """(root, absorbed_by): the shortest other root that a root is in, null for those that stay. Case, slashes and repeats do not count; of repeats the first in order stays.

    A root meets its own parents only, by an equi-join.
    """
    plain = F.rtrim(F.replace(F.lower("root"), F.lit("/"), F.lit("\\")), F.lit("\\"))
    own = roots.select("root").distinct().withColumn("plain", plain)
    first = own.groupBy("plain").agg(F.min("root").alias("name"))
    parts = F.split("plain", r"\\")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "\\"))
    met = own.select("root", F.posexplode(above).alias("n", "plain")).join(first, "plain").where("root <> name")
    least = met.groupBy("root").agg(F.min(F.struct("n", "name")).alias("by"))
    return own.join(least, "root", "left").select("root", F.col("by.name").alias("absorbed_by"))


def unique_names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """(file_key, name): names of a folder made unique by ``__n`` before the extension, counted past those taken (folder, name) without regard to case."""
    of = Window.partitionBy("folder", F.lower("name")).orderBy("file_key")
    own = wanted.withColumn("n", F.row_number().over(of) - 1)
    stem, ext = F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 2)
    used = taken.select("folder", F.lower("name").alias("low")).distinct()
    bare = F.lower(F.concat(F.regexp_extract("low", r"^(.*?)(__[0-9]+)?(\.[^.]*)?$", 1), F.regexp_extract("low", r"^(.*?)(__[0-9]+)?(\.[^.]*)?$", 3)))
    number = F.coalesce(F.expr(r"try_cast(regexp_extract(low, '__([0-9]+)(\\.[^.]*)?$', 1) as bigint)"), F.lit(0))
    most = used.select("folder", bare.alias("low"), number.alias("k")).groupBy("folder", "low").agg(F.max("k").alias("most"))
    both = own.withColumn("low", F.lower("name")).join(most, ["folder", "low"], "left")
    at = F.coalesce(F.col("most") + 1, F.lit(0)) + F.col("n")
    return both.select("file_key", F.when(at == 0, F.col("name")).otherwise(F.concat(stem, F.lit("__"), at.cast("string"), ext)).alias("name"))


def settings(text: Column, drives: list[str]) -> Column:
    """struct<retention_days, quarantine_drive> of a settings text: what is not valid falls back to its default, a drive that is gone to none."""
    raw = F.from_json(text, "retentionDays int, quarantineDrive string")
    days = F.when(raw["retentionDays"] >= 1, raw["retentionDays"]).otherwise(RETENTION_DAYS)
    return F.struct(days.alias("retention_days"), F.when(F.upper(raw["quarantineDrive"]).isin([d.upper() for d in drives]), raw["quarantineDrive"]).alias("quarantine_drive"))


def catalog_folder(preferred: str, legacy: str, exists) -> str:
    """Where the catalog is: the preferred folder, or the legacy one if only that has one."""
    return legacy if not exists(preferred) and exists(legacy) else preferred
