"""Which copy survives: scores, reasons, ranking; and the plan made of it."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinsight.functions.names import COPY_SUFFIX, GENERIC_NAME, stem, tier, tier_name
from kinsight.storage import stored

# Fixed values of the policy.
DEMOTED = ("\\backup", "\\temp", "\\tmp", "\\new folder", "\\downloads", "\\recycle", "\\cache", " - copy")
PIXEL_BAND, TAG_BAND, QUALITY_BAND = 1.2, 4, 5


@dataclass(frozen=True)
class Policy:
    preferred: tuple[str, ...] = ()
    demoted: tuple[str, ...] = DEMOTED


def _any(path: Column, fragments: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for f in fragments:
        found = found | path.contains(f.lower())
    return found


def score(policy: Policy = Policy()) -> Column:
    """Points for where a file is and what it is called; they decide only what the picture itself leaves open."""
    path = F.concat(F.lit("\\"), F.lower("rel_path"))
    name = stem(F.col("name"))
    depth = F.length("rel_path") - F.length(F.replace("rel_path", F.lit("\\"), F.lit("")))
    age = F.greatest(F.lit(-5), F.least(F.lit(5), F.expr("(4000000000 - mtime div 10000000) div 50000000")))
    return (
        F.when(_any(path, policy.preferred), 100).otherwise(0)
        + F.when(_any(path, policy.demoted), -60).otherwise(0)
        - 2 * F.least(depth, F.lit(12))
        + F.when(name.rlike(GENERIC_NAME), 0).otherwise(30)
        + F.when(name.rlike(COPY_SUFFIX), -40).otherwise(0)
        + age
    ).cast("int")


def reasons(policy: Policy = Policy()) -> Column:
    path = F.concat(F.lit("\\"), F.lower("rel_path"))
    name = stem(F.col("name"))
    q = F.col("jpeg_quality")
    parts = [
        F.when(F.col("date_taken").isNotNull(), F.concat(F.lit("capture date "), F.date_format(F.timestamp_seconds("date_taken"), "yyyy-MM-dd")))
        .when(F.col("has_exif"), "EXIF but no capture date")
        .otherwise("NO metadata"),
        F.when(F.coalesce(F.col("has_gps"), F.lit(False)), "has GPS"),
        F.when(q >= 90, F.concat(F.lit("quality ~"), q.cast("string"))).when(q <= 70, F.concat(F.lit("re-compressed ~"), q.cast("string"))),
        F.when(_any(path, policy.preferred), "in a preferred folder"),
        F.when(_any(path, policy.demoted), "in a scratch/backup folder"),
        F.when(~name.rlike(GENERIC_NAME), "descriptive filename"),
        F.when(name.rlike(COPY_SUFFIX), "looks like a copy"),
    ]
    return F.concat_ws("; ", F.array_compact(F.array(*parts)))


def scored(files: DataFrame, policy: Policy = Policy()) -> DataFrame:
    rows = files if "has_gps" in files.columns else files.withColumn("has_gps", F.lit(False))
    pixels = F.col("img_width").cast("bigint") * F.col("img_height")
    return rows.withColumns({"score": score(policy), "reasons": reasons(policy), "tier": tier(F.col("name")), "pixels": F.coalesce(pixels, F.lit(0).cast("bigint"))})


def rank_by_band(rows: DataFrame, group: str) -> DataFrame:
    """``rank`` in each group, by tolerance bands below the group's best: a total order, in SQL.

    A file's pixels, tags and quality count as the group's best if they are within the policy's tolerance of it.
    """
    best = rows.groupBy(group).agg(F.max("pixels").alias("__p"), F.max("exif_tags").alias("__t"), F.max("jpeg_quality").alias("__q"))
    own = rows.join(best, group)
    order = [
        F.desc(F.when(F.col("pixels") * PIXEL_BAND >= F.col("__p"), F.col("__p")).otherwise(F.col("pixels"))),
        F.desc(F.col("date_taken").isNotNull()),
        F.desc("tier"),
        F.desc(F.when((F.col("__t") - F.col("exif_tags")) * TAG_BAND <= F.col("__t"), F.col("__t")).otherwise(F.col("exif_tags"))),
        F.desc(F.when(F.col("jpeg_quality").isNull() | (F.col("__q") - F.col("jpeg_quality") <= QUALITY_BAND), F.col("__q")).otherwise(F.col("jpeg_quality"))),
        F.desc("score"),
        F.lower("rel_path"),
        F.col("file_key"),
    ]
    return own.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).drop("__p", "__t", "__q")


def _compare(a, b) -> int:
    """Negative if a is to be kept rather than b. The bands are between the two, so this is no order of a whole group."""
    big, small = max(a.pixels, b.pixels), min(a.pixels, b.pixels)
    if big != small and (small == 0 or big / small > PIXEL_BAND):
        return -1 if a.pixels == big else 1
    for x, y in ((pd.notna(a.date_taken), pd.notna(b.date_taken)), (a.tier, b.tier)):
        if x != y:
            return -1 if x > y else 1
    if abs(a.exif_tags - b.exif_tags) * TAG_BAND > max(a.exif_tags, b.exif_tags):
        return -1 if a.exif_tags > b.exif_tags else 1
    if pd.notna(a.jpeg_quality) and pd.notna(b.jpeg_quality) and abs(a.jpeg_quality - b.jpeg_quality) > QUALITY_BAND:
        return -1 if a.jpeg_quality > b.jpeg_quality else 1
    if a.score != b.score:
        return -1 if a.score > b.score else 1
    p, q = a.rel_path.lower(), b.rel_path.lower()
    return (p > q) - (p < q)


def rank_pairwise(rows: DataFrame, group: str) -> DataFrame:
    """(group, file_key, rank) by the pairwise comparison, from path order. Needs each group in one task."""

    def ranked(g: pd.DataFrame) -> pd.DataFrame:
        order = sorted(g.sort_values(["rel_path", "file_key"]).itertuples(), key=functools.cmp_to_key(_compare))
        return pd.DataFrame({group: [getattr(r, group) for r in order], "file_key": [r.file_key for r in order], "rank": range(1, len(order) + 1)})

    kind = dict(rows.dtypes)[group]
    own = rows.select(group, "file_key", "pixels", "date_taken", "tier", "exif_tags", "jpeg_quality", "score", "rel_path")
    return own.groupBy(group).applyInPandas(ranked, f"`{group}` {kind}, file_key bigint, rank int")


def loss(loser: Column, keeper: Column) -> Column:
    """What is lost with a copy, in words."""
    parts = [
        F.when(loser["tier"] > keeper["tier"], F.concat(tier_name(loser["tier"]), F.lit(" ORIGINAL, keeper is only "), tier_name(keeper["tier"]))),
        F.when(loser["pixels"] < keeper["pixels"], F.format_string("lower resolution (%dx%d)", loser["img_width"], loser["img_height"])),
        F.when(loser["exif_tags"] < keeper["exif_tags"], "less metadata"),
        F.when(loser["exif_tags"] > keeper["exif_tags"], "MORE metadata than keeper"),
        F.when(loser["date_taken"].isNotNull() & keeper["date_taken"].isNull(), "HAS capture date, keeper does not"),
        F.when(loser["jpeg_quality"] < keeper["jpeg_quality"], F.concat(F.lit("lower quality (~"), loser["jpeg_quality"].cast("string"), F.lit(")"))),
    ]
    text = F.concat_ws("; ", F.array_compact(F.array(*parts)))
    return F.when(text == "", "duplicate of keeper").otherwise(text)


_CARRIED = ("file_key", "tier", "pixels", "img_width", "img_height", "exif_tags", "date_taken", "jpeg_quality")


def build_plan(rows: DataFrame, group: str, kind: str = "ExactBytes", min_reclaimable: int = 1, skip_offline: bool = True, split_tiers: bool = True) -> DataFrame:
    """Plan rows of scored files with a group and ``attached``: a keeper and what goes, with reasons.

    Names of one physical file are one row; formats of different tiers are
    never duplicates of each other; groups that hold an offline copy, a single
    file, or too little to gain are left out. Groups are numbered by their
    first file key.
    """
    from kinsight.operators.exact import physical_key

    own = rows.withColumn("__physical", physical_key())
    first = own.groupBy(group, "__physical").agg(F.min("file_key").alias("file_key")).select("file_key", group)
    own = own.join(first, [group, "file_key"], "left_semi").drop("__physical")
    own = own.withColumn("__g", F.struct(F.col(group), F.col("tier") if split_tiers else F.lit(0).alias("tier")))
    sums = own.groupBy("__g").agg(F.count(F.lit(1)).alias("n"), F.bool_or(~F.col("attached")).alias("offline"), F.min("file_key").alias("__first"))
    some = own.join(sums.where("n > 1" + (" and not offline" if skip_offline else "")), "__g")
    ranked = rank_by_band(some.withColumn("__key", F.col("__first")), "__key")
    keepers = ranked.where("rank = 1").select("__key", F.struct(*_CARRIED).alias("keeper"))
    gains = ranked.where("rank > 1").groupBy("__key").agg(F.sum("size").alias("gain")).where(F.col("gain") >= min_reclaimable)
    joined = ranked.join(keepers, "__key").join(gains, "__key")
    keeps = F.col("rank") == 1
    return joined.select(
        F.col("__key").alias("group_key"),
        F.lit(kind).alias("kind"),
        F.when(keeps, "Keep").otherwise("Quarantine").alias("action"),
        "file_key",
        F.when(~keeps, F.col("keeper.file_key")).alias("kept_file_key"),
        "score",
        "img_width",
        "img_height",
        "size",
        "has_exif",
        "exif_tags",
        "date_taken",
        "jpeg_quality",
        "volume_id",
        "rel_path",
        "pixel_hash",
        F.when(keeps, F.col("reasons")).otherwise(loss(F.struct(*_CARRIED), F.col("keeper"))).alias("reason"),
        "content_hash",
        "offline",
    )


def number_groups(plan: DataFrame) -> DataFrame:
    """plan with ``group_no`` from 1, in order of group_key: ranks within range partitions, on top of the groups before them."""
    keys = plan.select("group_key").distinct().repartitionByRange("group_key").withColumn("p", F.spark_partition_id())
    keys = stored(keys.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy("group_key"))), "ranked")  # both uses see the same partitions
    sizes = keys.groupBy("p").agg(F.count(F.lit(1)).alias("n")).agg(F.collect_list(F.struct("p", "n")).alias("sizes"))
    before = F.aggregate(F.filter("sizes", lambda s: s["p"] < F.col("p")), F.lit(0).cast("bigint"), lambda a, s: a + s["n"])
    numbers = keys.join(F.broadcast(sizes)).select("group_key", (before + F.col("r")).alias("group_no"))
    return plan.join(numbers, "group_key")


def plan_summary(plan: DataFrame) -> DataFrame:
    """Groups, rows to keep and to move, bytes, offline groups, and groups whose keeper has less metadata than a loser."""
    keeper = plan.where("action = 'Keep'").select("group_key", F.col("exif_tags").alias("kt"), F.col("date_taken").alias("kd"))
    joined = plan.join(keeper, "group_key")
    goes = F.col("action") == "Quarantine"
    poorer = goes & ((F.col("exif_tags") > F.col("kt")) | (F.col("date_taken").isNotNull() & F.col("kd").isNull()))
    by_group = joined.groupBy("group_key").agg(
        F.count_if(goes).alias("goes"), F.sum(F.when(goes, F.col("size")).otherwise(0)).alias("bytes"), F.bool_or(poorer).alias("poorer"), F.bool_or("offline").alias("offline")
    )
    return by_group.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.count(F.lit(1)).alias("keep"),
        F.coalesce(F.sum("goes"), F.lit(0)).alias("quarantine"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("reclaimable"),
        F.count_if("offline").alias("offline_groups"),
        F.count_if("poorer").alias("poorer_groups"),
    )
