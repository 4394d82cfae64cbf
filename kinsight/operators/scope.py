"""Which files a command is about: subtree scopes, crawl filters, staleness, reconciliation, merging."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsight.functions.names import LOSSLESS, LOSSY, RAW, extension
from kinsight.functions.metadata import META_STATE
from kinsight.storage import stored

# Fixed values of the crawl.
EXTENSIONS = (".jpg", ".jpeg", ".jpe", ".jfif", ".png", ".gif", ".bmp", ".webp", ".tif", ".tiff", ".heic", ".heif", ".avif", *RAW)
EXCLUDED_FOLDERS = (
    "$RECYCLE.BIN",
    "System Volume Information",
    "$Extend",
    "Config.Msi",
    "Windows",
    "Program Files",
    "Program Files (x86)",
    "ProgramData",
    "node_modules",
    ".git",
    ".svn",
    "AppData",
)
CLOUD_LABELS = ("google drive", "onedrive", "dropbox", "icloud", "mega", "pcloud", "box", "sync", "nextcloud")
MIN_SIZE = 16 * 1024
HIDDEN, SYSTEM, REPARSE, OFFLINE = 0x2, 0x4, 0x400, 0x1000
RECALL_ON_OPEN, RECALL_ON_DATA = 0x40000, 0x400000
CLOUD = OFFLINE | RECALL_ON_OPEN | RECALL_ON_DATA
CLOUD_TAG, CLOUD_TAG_MASK = 0x9000001A, 0xFFFF0FFF
SMALL_VOLUME = 2 * 1024**3

assert set(LOSSLESS) | set(LOSSY) | set(RAW) == set(EXTENSIONS)


def split_drive(path: str) -> tuple[str | None, str]:
    """("F:", "Photos") of "F:\\Photos"; no drive for a relative path. Quotes and outer backslashes go."""
    p = path.strip().strip("\"'").strip("\\")
    if len(p) >= 2 and p[0].isalpha() and p[1] == ":":
        return p[:2].upper(), p[2:].strip("\\")
    return None, p


@dataclass(frozen=True)
class Scope:
    """Files under any of ``under`` and with none of ``exclude`` in their path; ASCII case does not matter.

    A subtree is a prefix of the path, of whole folders only with ``segments``.
    The drive of an excluded path is not looked at.
    """

    under: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    segments: bool = False

    def predicate(self, mount: str = "last_mount_point", path: str = "rel_path") -> Column:
        tests = []
        for u in self.under:
            drive, rel = split_drive(u)
            parts = []
            if drive:
                parts.append(F.lower(F.col(mount)).startswith(drive.lower()))
            if rel:
                low, start = F.lower(F.col(path)), rel.lower()
                parts.append(((low == start) | low.startswith(start + "\\")) if self.segments else low.startswith(start))
            if parts:
                tests.append(reduce(lambda a, b: a & b, parts))
        inside = reduce(lambda a, b: a | b, tests) if tests else F.lit(True)
        for e in self.exclude:
            inside = inside & ~F.lower(F.col(path)).contains(split_drive(e)[1].lower())
        return F.coalesce(inside, F.lit(False))

    def describe(self) -> str:
        parts = [f"under {', '.join(self.under)}"] if self.under else []
        parts += [f"excluding {', '.join(self.exclude)}"] if self.exclude else []
        return "; ".join(parts) or "everything"


def in_scope(files: DataFrame, volumes: DataFrame, scope: Scope) -> DataFrame:
    """files with their volume's mount, those in scope only. volumes is a dimension of a few rows."""
    return files.join(F.broadcast(volumes.select("volume_id", "last_mount_point")), "volume_id").where(scope.predicate())


@dataclass(frozen=True)
class Crawl:
    extensions: tuple[str, ...] = EXTENSIONS
    min_size: int = MIN_SIZE
    folders: tuple[str, ...] = EXCLUDED_FOLDERS
    fragments: tuple[str, ...] = field(default=())
    cloud: bool = False
    hidden: bool = False
    system: bool = False
    reparse: bool = False


def refusal(crawl: Crawl, reparse_tag: Column | None = None) -> Column:
    """Why a listed file is not taken into the catalog; null if it is. Files have rel_path, name, size and attributes."""
    has = lambda mask: F.col("attributes").bitwiseAND(F.lit(mask)) != 0
    folders = F.slice(F.split(F.lower("rel_path"), r"\\"), 1, F.greatest(F.size(F.split("rel_path", r"\\")) - 1, F.lit(0)))
    refused = F.when(F.arrays_overlap(folders, F.array(*[F.lit(x.lower()) for x in crawl.folders])), "excluded folder")
    for fragment in crawl.fragments:
        refused = refused.when(F.lower("rel_path").contains(fragment.lower()), "excluded path")
    if crawl.extensions:
        refused = refused.when(~F.coalesce(extension(F.col("name")).isin(*crawl.extensions), F.lit(False)), "extension")
    refused = refused.when(F.col("size") < crawl.min_size, "too small")
    if not crawl.cloud:
        refused = refused.when(has(CLOUD), "cloud placeholder")
    if not crawl.reparse:
        hydrated = F.lit(False) if reparse_tag is None else F.coalesce(reparse_tag.bitwiseAND(F.lit(CLOUD_TAG_MASK)) == CLOUD_TAG, F.lit(False))
        refused = refused.when(has(REPARSE) & ~hydrated, "link")
    if not crawl.hidden:
        refused = refused.when(has(HIDDEN), "hidden")
    if not crawl.system:
        refused = refused.when(has(SYSTEM), "system")
    return refused


def scan_targets(volumes: DataFrame) -> DataFrame:
    """volumes with ``recommended`` and the reason against it."""
    label = F.lower(F.coalesce("label", F.lit("")))
    why = (
        F.when(F.col("last_mount_point").isNull(), "no drive letter or mount point")
        .when(F.col("storage_kind") == "Remote", "network drive")
        .when(reduce(lambda a, b: a | b, [label.contains(c) for c in CLOUD_LABELS]), "cloud sync drive")
        .when(F.col("total_bytes") < SMALL_VOLUME, "smaller than 2 GB")
        .otherwise("")
    )
    return volumes.withColumn("reason", why).withColumn("recommended", F.col("reason") == "")


def owning_volume(paths: DataFrame, volumes: DataFrame, path: str = "path") -> DataFrame:
    """paths with the volume of the longest mount point that begins it; null where none does. volumes is a dimension of a few rows."""
    mounts = F.broadcast(volumes.where("last_mount_point is not null").agg(F.collect_list(F.struct(F.length("last_mount_point").alias("n"), "last_mount_point", "volume_id")).alias("mounts")))
    fitting = F.filter("mounts", lambda m: F.lower(F.col(path)).startswith(F.lower(m["last_mount_point"])))
    return paths.join(mounts).withColumn("volume_id", F.array_max(fitting)["volume_id"]).drop("mounts")


def stale_hash() -> Column:
    """A file's probe is missing or was made of another size or time."""
    return F.col("partial_hash").isNull() | F.coalesce((F.col("hashed_size") != F.col("size")) | (F.col("hashed_mtime") != F.col("mtime")), F.lit(True))


def undecoded(retry_failures: bool = False) -> Column:
    return (F.col("decode_state") == 0) | (F.col("decode_state") == 2) if retry_failures else F.col("decode_state") == 0


def unread_metadata() -> Column:
    return F.col("meta_state") < META_STATE


def mark_missing(files: DataFrame, volume_id: int, scan_id: int, root: str) -> DataFrame:
    """present is false for files of a volume's scanned subtree that the scan has not seen; whole folders, ASCII case aside."""
    low = F.lower("rel_path")
    inside = F.lit(True) if not root else (low == root.lower()) | low.startswith(root.lower() + "\\")
    gone = (F.col("volume_id") == volume_id) & (F.col("last_scan_id") != scan_id) & inside
    return files.withColumn("present", F.when(gone, F.lit(False)).otherwise(F.col("present")))


CRAWLED = ("name", "ext", "size", "mtime", "ctime", "attributes", "file_id_low", "last_scan_id")


def merge_catalog(files: DataFrame, crawled: DataFrame, next_key: int) -> DataFrame:
    """Upsert by (volume_id, rel_path): crawled columns are replaced and present set; hashes and fingerprints stay.

    New files are numbered from next_key in path order. crawled has each path once.
    """
    new = crawled.select("volume_id", "rel_path", F.struct(*[c for c in CRAWLED if c in crawled.columns]).alias("__c"))
    both = files.join(new, ["volume_id", "rel_path"], "full")
    fresh = both.where("file_key is null").select("volume_id", "rel_path")
    ranked = fresh.repartitionByRange("volume_id", "rel_path").sortWithinPartitions("volume_id", "rel_path").withColumn("__p", F.spark_partition_id())
    # a global row number without one task for all rows: counts of the range partitions come first
    ranked = ranked.withColumn("__i", F.row_number().over(_window("__p", "volume_id", "rel_path")))
    ranked = stored(ranked, "ranked")  # both uses see the same partitions
    sizes = ranked.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.agg(F.sort_array(F.collect_list(F.struct("__p", "n"))).alias("sizes"))
    offset = F.aggregate(F.filter("sizes", lambda s: s["__p"] < F.col("__p")), F.lit(0).cast("bigint"), lambda a, s: a + s["n"])
    keys = ranked.join(F.broadcast(before)).select("volume_id", "rel_path", (F.lit(next_key) + offset + F.col("__i") - 1).alias("__key"))
    both = both.join(keys, ["volume_id", "rel_path"], "left").withColumn("file_key", F.coalesce("file_key", "__key"))
    columns = []
    for c in files.columns:
        if c == "present":
            columns.append((F.col("__c").isNotNull() | F.coalesce("present", F.lit(False))).alias(c))
        elif c in CRAWLED and c in crawled.columns:
            columns.append(F.when(F.col("__c").isNotNull(), F.col(f"__c.{c}")).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(c))
    return both.select(*columns)


def _window(part: str, *order: str):
    from pyspark.sql import Window

    return Window.partitionBy(part).orderBy(*order)
