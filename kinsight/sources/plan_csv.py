"""Plans and manifests as CSV files that a person may edit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the file format.
COLUMNS = (
    "group", "kind", "action", "file_key", "kept_file_key", "score", "width", "height", "size", "has_exif", "exif_tags", "date_taken", "jpeg_quality", "volume_guid", "volume", "path", "pixel_hash", "reason",
)
BOM = "\ufeff"
KINDS = ("ExactBytes", "IdenticalPicture", "NearDuplicate", "ReviewedByHuman")
ACTIONS = ("Keep", "Quarantine", "Skip")
MANIFEST = ("action_id", "origin_volume", "origin_rel", "destination", "size", "state")
_LONGS = ("group", "file_key", "score", "width", "height", "size", "has_exif", "exif_tags")
_OPTIONAL = ("kept_file_key", "jpeg_quality")


def write_plan(plan: DataFrame, path: str) -> None:
    """plan has COLUMNS; numbers stay numbers, texts are quoted where they must be. Each file begins with a byte-order mark, as part of its header."""
    plan.select(*[F.col(c).cast("string").alias(BOM + c if c == COLUMNS[0] else c) for c in COLUMNS]).write.mode("overwrite").option("header", "true").option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """Plan rows as edited: lines that are short, or name an unknown kind or action, are left out; bad numbers are 0."""
    schema = ", ".join(f"`{c}` string" for c in COLUMNS) + ", __bad string"
    raw = (
        spark.read.schema(schema).option("header", "true").option("enforceSchema", "true").option("quote", '"').option("escape", '"')
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__bad").option("multiLine", "true").csv(path)
    )

    def named(column: str, names: tuple[str, ...]):
        chain = None
        for n in names:
            test = F.lower(F.trim(column)) == n.lower()
            chain = F.when(test, n) if chain is None else chain.when(test, n)
        return chain

    rows = raw.where("__bad is null or reason is not null").withColumns({"kind": named("kind", KINDS), "action": named("action", ACTIONS)}).where("kind is not null and action is not null")
    number = lambda c: F.coalesce(F.col(c).try_cast("bigint"), F.lit(0).cast("bigint"))
    casts = {c: number(c) for c in _LONGS} | {c: F.col(c).try_cast("bigint") for c in _OPTIONAL} | {"date_taken": F.try_to_date("date_taken", "yyyy-MM-dd")}
    texts = {c: F.coalesce(c, F.lit("")) for c in ("volume_guid", "volume", "path", "reason")}
    return rows.withColumns(casts | texts).select(*COLUMNS)


def write_manifest(actions: DataFrame, batch: str, path: str, done_only: bool = False) -> None:
    rows = actions.where(F.col("batch_id") == batch)
    rows = rows.where("state = 'done'") if done_only else rows
    rows.select(*[F.col(c).cast("string") for c in MANIFEST]).orderBy(F.col("action_id").cast("bigint")).coalesce(1).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in MANIFEST)
    rows = spark.read.schema(schema).option("header", "true").option("escape", '"').option("mode", "DROPMALFORMED").csv(path)
    return rows.withColumns({"action_id": F.col("action_id").try_cast("bigint"), "size": F.coalesce(F.col("size").try_cast("bigint"), F.lit(0).cast("bigint"))})
