"""Near duplicates: a banded Hamming self-join, verified by thumbnails and guarded by capture time and series names.

Two hashes within T bits agree on one of T + 1 bands, so the theta join becomes
an equi-join on bands. A list of pairs holds every pair, copies too: n files of
one fingerprint make n (n - 1) / 2. Clusters need connections only: files that
nothing tells apart are one node first, and hang on it by one edge each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsight.functions.names import series
from kinsight.operators import banded
from kinsight.operators.components import components
from kinsight.storage import stored


@dataclass(frozen=True)
class Similarity:
    max_hamming: int = 4
    max_thumbnail: float = 8.0
    min_contrast: float = 6.0
    #: None joins all buckets; a number counts larger ones and leaves them out, on request, as a guard against flat pictures.
    max_bucket: int | None = None
    guards: bool = True


def usable(files: DataFrame, prints: DataFrame) -> DataFrame:
    """Present, decoded files with their fingerprints."""
    return files.where("present and decode_state = 1").join(prints, "file_key")


def buckets(rows: DataFrame, options: Similarity = Similarity()) -> DataFrame:
    """(kind, band, key, n) of the buckets that two rows or more are in."""
    return banded.sizes(rows, options.max_hamming).where("n > 1")


def candidate_pairs(rows: DataFrame, options: Similarity = Similarity()) -> DataFrame:
    """Distinct (i, j), i < j, of rows (file_key, dhash, phash) that share a band."""
    return banded.candidates(rows, options.max_hamming, options.max_bucket)


def near_pairs(rows: DataFrame, options: Similarity = Similarity()) -> DataFrame:
    """(i, j, hamming, thumbnail, separate, confirmed) of all pairs within max_hamming; of enough contrast only.

    Pairs are judged where their buckets meet, so only near ones leave a task. A file without a name is of no series.
    """
    number = series(F.col("name"))
    clear = rows.where(F.col("contrast") >= options.min_contrast).withColumns({"prefix": F.lower(number["prefix"]), "number": number["number"]})
    near = banded.near(clear, options.max_hamming, options.max_bucket)
    near = near if options.guards else near.withColumn("separate", F.lit(False))
    return near.withColumn("confirmed", ~F.col("separate") & (F.col("thumbnail") <= options.max_thumbnail))


def histogram(values: DataFrame, column: str, size: int) -> DataFrame:
    """Counts of floor(column), clamped to size - 1, with empty cells as 0."""
    cell = F.least(F.floor(column), F.lit(size - 1)).cast("bigint")
    counts = values.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    return values.sparkSession.range(size).select(F.col("id").alias("cell")).join(counts, "cell", "left").select("cell", F.coalesce("n", F.lit(0)).alias("n"))


def calibration(pairs: DataFrame, options: Similarity = Similarity(), bar: int = 40) -> DataFrame:
    """The thumbnail histogram as bars scaled to the peak, each cell marked keep or drop."""
    cells = histogram(pairs.where("not separate"), "thumbnail", 64)
    peak = cells.agg(F.max("n").alias("peak"))
    scaled = F.when(F.col("peak") > 0, F.expr(f"cast(n * {bar} div peak as int)")).otherwise(0)
    return cells.join(F.broadcast(peak)).select(
        "cell", "n", F.repeat(F.lit("#"), scaled).alias("bar"), F.when(F.col("cell") < options.max_thumbnail, "keep").otherwise("drop").alias("verdict")
    )


def collapse_identical(rows: DataFrame) -> DataFrame:
    """file_key with ``rep``: within equal (dhash, phash), the first earlier file it is no separate exposure of.

    The order decides, so a group's distinct moments and names are walked one by one, each group by itself.
    """
    import pandas as pd

    own = rows.select("file_key", "dhash", "phash", "date_taken", "sub_sec", series(F.col("name")).alias("s"))
    own = own.select("file_key", "dhash", "phash", "date_taken", "sub_sec", F.lower("s.prefix").alias("prefix"), F.col("s.number").alias("number"))
    # files that no guard can tell apart are one row before any group is collected
    kinds = own.groupBy("dhash", "phash", "date_taken", "sub_sec", "prefix", "number").agg(F.min("file_key").alias("first"))

    def apart(a, b) -> bool:
        if pd.notna(a.date_taken) and pd.notna(b.date_taken):
            return a.date_taken != b.date_taken or (pd.notna(a.sub_sec) and pd.notna(b.sub_sec) and a.sub_sec != b.sub_sec)
        return bool(a.prefix and a.number and b.number) and a.prefix == b.prefix and a.number != b.number

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        heads, reps = [], []
        for row in group.sort_values("first").itertuples():
            head = next((h for h in heads if not apart(h, row)), None)
            if head is None:
                heads.append(head := row)
            reps.append((row.first, head.first))
        return pd.DataFrame(reps, columns=["first", "rep"])

    reps = kinds.groupBy("dhash", "phash").applyInPandas(walk, "first bigint, rep bigint")
    keyed = kinds.join(reps, "first")
    same = [own[c].eqNullSafe(keyed[c]) for c in ("dhash", "phash", "date_taken", "sub_sec", "prefix", "number")]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return own.join(keyed, condition).select(own["file_key"], keyed["rep"])


def alike(rows: DataFrame, options: Similarity = Similarity()) -> DataFrame:
    """(file_key, head) of the files of enough contrast: the least of those that neither pictures nor guards tell apart."""
    facts = ["dhash", "phash", "thumb16", "contrast", "thumb_mean", "date_taken", "sub_sec"]
    number = series(F.col("name"))
    key = F.struct(*facts, F.lower(number["prefix"]).alias("prefix"), number["number"].alias("number"))
    own = rows.where(F.col("contrast") >= options.min_contrast).select("file_key", key.alias("facts"))
    heads = own.groupBy("facts").agg(F.min("file_key").alias("head"))
    return own.join(heads, "facts").select("file_key", "head")


def clusters(rows: DataFrame, options: Similarity = Similarity()) -> DataFrame:
    """(file_key, cluster): connected by equal pictures and by confirmed pairs, then split by exposure; clusters of two files or more, named by their least key."""
    first = rows.where("pixel_hash is not null").groupBy("pixel_hash").agg(F.min("file_key").alias("v"))
    same = rows.join(first, "pixel_hash").select(F.col("file_key").alias("u"), "v")
    heads = stored(alike(rows, options), "alike")
    one = rows.join(heads.where("file_key = head").select("file_key"), "file_key", "left_semi")
    confirmed = near_pairs(one, options).where("confirmed").select(F.col("i").alias("u"), F.col("j").alias("v"))
    copies = heads.where("file_key <> head").select(F.col("file_key").alias("u"), F.col("head").alias("v"))
    linked = stored(components(same.unionByName(confirmed).unionByName(copies)), "clusters")
    return split_by_exposure(linked.withColumnRenamed("node", "file_key").withColumnRenamed("component", "cluster"), rows)


def split_by_exposure(linked: DataFrame, rows: DataFrame) -> DataFrame:
    """Clusters of several moments are regrouped by moment; undated files join the first dated one of their picture, or leave.

    Moments and pictures are small aggregates of a cluster, joined back, so no cluster is collected.
    """
    own = linked.join(rows.select("file_key", "date_taken", "sub_sec", "pixel_hash"), "file_key")
    own = own.withColumn("moment", F.when(F.col("date_taken").isNotNull(), F.struct("date_taken", F.coalesce("sub_sec", F.lit(-1)).alias("part"))))
    counts = own.groupBy("cluster").agg(F.countDistinct("moment").alias("moments"))
    pictures = own.where("moment is not null").groupBy("cluster", "pixel_hash").agg(F.min_by("moment", "file_key").alias("borrowed"))
    all_ = own.join(counts, "cluster").join(pictures, ["cluster", "pixel_hash"], "left")
    at = F.coalesce("moment", "borrowed")
    part = F.when(F.col("moments") <= 1, F.lit("all")).when(at.isNotNull(), F.concat_ws(":", at["date_taken"].cast("string"), at["part"].cast("string"))).otherwise(
        F.concat(F.lit("alone:"), F.col("file_key").cast("string"))
    )
    parts = all_.select("file_key", "cluster", part.alias("part"))
    heads = parts.groupBy("cluster", "part").agg(F.min("file_key").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return parts.join(heads, ["cluster", "part"]).select("file_key", F.col("head").alias("cluster"))


def cluster_metrics(members: DataFrame, rows: DataFrame) -> DataFrame:
    own = members.join(rows.select("file_key", "pixel_hash", "size", "img_width", "img_height"), "file_key")
    return own.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("files"),
        (F.countDistinct("pixel_hash") == 1).alias("pixel_identical"),
        (F.count(F.lit(1)) - F.countDistinct("pixel_hash")).alias("metadata_only"),
        (F.sum("size") - F.max("size")).alias("reclaimable"),
        F.max(F.col("img_width").cast("bigint") * F.col("img_height")).alias("max_pixels"),
    )


def pixel_groups(members: DataFrame, rows: DataFrame) -> DataFrame:
    """Pictures of each cluster, the most frequent first, then the largest."""
    from pyspark.sql import Window

    own = members.join(rows.select("file_key", "pixel_hash", "size"), "file_key").groupBy("cluster", "pixel_hash")
    found = own.agg(F.count(F.lit(1)).alias("files"), F.max("size").alias("largest"), F.min("file_key").alias("first_key"))
    order = Window.partitionBy("cluster").orderBy(F.desc("files"), F.desc("largest"), "first_key")
    return found.withColumn("rank", F.row_number().over(order))


def cluster_keys(members: DataFrame) -> DataFrame:
    """(cluster, cluster_key): a name that the members alone decide."""
    text = F.concat(F.array_join(F.transform(F.array_sort(F.collect_set("file_key")), lambda k: k.cast("string")), ","), F.lit(","))
    return members.groupBy("cluster").agg(F.left(F.sha2(text, 256), F.lit(32)).alias("cluster_key"))


def pixel_only() -> Similarity:
    return Similarity(max_hamming=0, max_thumbnail=0.0)


def totals(rows: DataFrame, pairs: DataFrame, options: Similarity = Similarity()) -> DataFrame:
    """Counters of a similarity run, over the whole set of pairs."""
    a = rows.agg(
        F.count(F.lit(1)).alias("decoded"),
        F.countDistinct("dhash", "phash").alias("distinct_prints"),
        F.count_if(F.col("contrast") < options.min_contrast).alias("held_back"),
        F.count_if(F.col("date_taken").isNotNull()).alias("with_time"),
    )
    b = pairs.agg(
        F.count(F.lit(1)).alias("near"), F.count_if("confirmed").alias("confirmed"), F.count_if("separate").alias("separate"), F.count_if(~F.col("confirmed") & ~F.col("separate")).alias("too_far")
    )
    return a.join(F.broadcast(b))
