"""Queries over what runs write back, and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsight.functions import names
from kinsight.operators import similar, state
from kinsight.plans.catalog_queries import _ACTIONS, _CLUSTERS, _PLAN, _acts, _clusters, _fv, _plan, query
from kinsight.plans.oracle_ctes import with_files, with_prints

def _k():
    return F.col("file_key")


@query(
    "write_probes",
    with_files(
        r"""SELECT file_key, CASE WHEN file_key % 5 = 0 THEN 'p' || file_key ELSE partial_hash END AS partial_hash, CASE WHEN file_key % 10 = 0 THEN 'c' || file_key ELSE content_hash END AS content_hash,
        CASE WHEN file_key % 5 = 0 THEN size ELSE hashed_size END AS hashed_size, CASE WHEN file_key % 5 = 0 THEN mtime ELSE hashed_mtime END AS hashed_mtime FROM files"""
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    files, _ = _fv(spark, sf)
    text = _k().cast("string")
    probed = files.where("file_key % 5 = 0").select("file_key", F.concat(F.lit("p"), text).alias("partial_hash"), F.when(_k() % 10 == 0, F.concat(F.lit("c"), text)).alias("content_hash"), "size", "mtime")
    return state.write_probes(files, probed).select("file_key", "partial_hash", "content_hash", "hashed_size", "hashed_mtime")


@query("write_hashes", with_files("SELECT file_key, CASE WHEN file_key % 7 = 0 THEN 'f' || file_key ELSE content_hash END AS content_hash FROM files"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    files, _ = _fv(spark, sf)
    return state.write_hashes(files, files.where("file_key % 7 = 0").select("file_key", F.concat(F.lit("f"), _k().cast("string")).alias("content_hash"))).select("file_key", "content_hash")


@query(
    "write_fingerprints",
    with_files(
        """SELECT file_key, CASE WHEN file_key % 6 = 0 THEN 'x' ELSE pixel_hash END AS pixel_hash, CASE WHEN file_key % 6 = 0 THEN 7 ELSE img_width END AS img_width,
        CASE WHEN file_key % 6 = 0 THEN 1 WHEN file_key % 15 = 1 THEN 2 ELSE decode_state END AS decode_state FROM files"""
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    files, _ = _fv(spark, sf)
    decoded = files.where("file_key % 6 = 0").select("file_key", F.lit("x").alias("pixel_hash"), F.lit(7).alias("img_width"), F.lit(8).alias("img_height"))
    return state.write_fingerprints(files, decoded, files.where("file_key % 15 = 1")).select("file_key", "pixel_hash", "img_width", "decode_state")


@query(
    "write_metadata",
    with_files(
        """SELECT file_key, CASE WHEN file_key % 4 = 0 AND file_key % 8 <> 0 THEN file_key WHEN file_key % 4 = 0 AND file_key % 3 = 0 THEN -file_key WHEN file_key % 4 = 0 THEN NULL WHEN file_key % 3 = 0 THEN -file_key ELSE date_taken END AS date_taken,
        CASE WHEN file_key % 4 = 0 THEN 5 WHEN file_key % 3 = 0 THEN 2 ELSE exif_tags END AS exif_tags, has_exif OR file_key % 4 = 0 AS has_exif, CASE WHEN file_key % 4 = 0 OR file_key % 3 = 0 THEN 4 ELSE meta_state END AS meta_state FROM files"""
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    files, _ = _fv(spark, sf)
    embedded = files.where("file_key % 4 = 0").select("file_key", F.when(_k() % 8 != 0, _k()).alias("date_taken"), F.lit(5).alias("exif_tags"))
    sidecars = files.where("file_key % 3 = 0").select("file_key", (-_k()).alias("date_taken"), F.lit(2).alias("exif_tags"))
    return state.write_metadata(files, embedded, sidecars).select("file_key", "date_taken", "exif_tags", "has_exif", "meta_state")


_SIDES = r"""
pics AS (SELECT file_key, volume_id, rel_path, regexp_replace(rel_path, '\.[^.\\]*$', '') AS bare FROM files WHERE file_key % 2 = 0),
sides AS (SELECT 1000000 + file_key AS file_key, volume_id, CASE file_key % 6 WHEN 0 THEN upper(bare) || '.XMP' WHEN 2 THEN rel_path || '.json' ELSE bare || '.json' END AS rel_path FROM pics
          UNION ALL SELECT 2000000 + file_key, volume_id, rel_path || '.xmp' FROM pics WHERE file_key % 4 = 0),
cand AS (SELECT file_key, volume_id, unnest([rel_path || '.json', rel_path || '.supplemental-metadata.json', bare || '.json', rel_path || '.xmp', bare || '.xmp']) AS path, unnest([0, 1, 2, 3, 4]) AS place FROM pics)
"""


@query(
    "sidecar_discovery",
    with_files(
        f""", {_SIDES}, met AS (SELECT c.file_key, s.file_key AS sidecar_key, place FROM cand c JOIN sides s ON c.volume_id = s.volume_id AND lower(c.path) = lower(s.rel_path) WHERE s.file_key % 5 <> 0)
        SELECT file_key, sidecar_key, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY file_key ORDER BY place, sidecar_key) AS r FROM met) WHERE r = 1"""
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    pics = _fv(spark, sf)[0].where("file_key % 2 = 0").select("file_key", "volume_id", "rel_path")
    bare = F.regexp_replace("rel_path", r"\.[^.\\]*$", "")
    one = F.when(_k() % 6 == 0, F.concat(F.upper(bare), F.lit(".XMP"))).when(_k() % 6 == 2, F.concat("rel_path", F.lit(".json"))).otherwise(F.concat(bare, F.lit(".json")))
    sides = pics.select((_k() + 1_000_000).alias("file_key"), "volume_id", one.alias("rel_path"))
    sides = sides.unionByName(pics.where("file_key % 4 = 0").select((_k() + 2_000_000).alias("file_key"), "volume_id", F.concat("rel_path", F.lit(".xmp")).alias("rel_path")))
    return state.find_sidecars(pics.unionByName(sides), sides.where("file_key % 5 <> 0")).where("file_key < 1000000")


@query("planned_actions", with_files(f", {_PLAN} SELECT 99 + row_number() OVER (ORDER BY file_key) AS action_id, 'b9' AS batch_id, file_key, kept_file_key, size, 'planned' AS state FROM plan WHERE action = 'Quarantine'"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return state.planned_actions(_plan(spark, sf), "b9", 100)


_LOG = """log AS (SELECT event_id % 400 AS action_id, event_id % 300 AS file_key, event_id AS seq, ['planned', 'done', 'failed', 'undone', 'purged'][1 + event_id % 5] AS state FROM events WHERE event_id % 400 < 380)"""


def _log(spark: SparkSession, sf: str) -> DataFrame:
    e, states = F.col("event_id"), F.array(*map(F.lit, ("planned", "done", "failed", "undone", "purged")))
    rows = spark.read.parquet(f"{sf}/events.parquet").where("event_id % 400 < 380")
    return rows.select((e % 400).alias("action_id"), (e % 300).alias("file_key"), e.alias("seq"), F.element_at(states, (1 + e % 5).cast("int")).alias("state"))


@query(
    "checked_moves",
    f"""WITH {_LOG}, last AS (SELECT action_id, arg_max(state, seq) AS was FROM log GROUP BY action_id), wanted AS (SELECT range AS action_id, ['done', 'failed', 'undone', 'purged'][1 + range % 4] AS state FROM range(400))
    SELECT action_id, was, state, CASE WHEN was IS NULL THEN 'unknown action' WHEN (was = 'planned' AND state IN ('done', 'failed')) OR (was = 'done' AND state IN ('undone', 'purged')) THEN 'moved' ELSE 'refused' END AS verdict
    FROM wanted LEFT JOIN last USING (action_id)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    to = F.element_at(F.array(*map(F.lit, ("done", "failed", "undone", "purged"))), (1 + F.col("id") % 4).cast("int"))
    return state.checked_moves(_log(spark, sf), spark.range(400).select(F.col("id").alias("action_id"), to.alias("state")))


@query(
    "present_after",
    with_files(
        f""", {_LOG}, last AS (SELECT file_key, arg_max(state, seq) AS s FROM log WHERE state IN ('done', 'undone') GROUP BY file_key)
        SELECT file_key, CASE s WHEN 'done' THEN false WHEN 'undone' THEN true ELSE present END AS present FROM files LEFT JOIN last USING (file_key)"""
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return state.present_after(_fv(spark, sf)[0], _log(spark, sf)).select("file_key", "present")


@query(
    "open_scans",
    r"""WITH runs AS (SELECT event_id AS scan_id, (event_id % 7)::INT AS volume_id, 'r' || (event_id % 5) AS root, CASE WHEN event_id % 3 = 0 THEN 'running' ELSE 'completed' END AS status FROM events WHERE event_id < 60),
    wanted AS (SELECT (range % 7)::INT AS volume_id, 'r' || (range % 6) AS root, range % 2 = 0 AS resume FROM range(42)), last AS (SELECT volume_id, root, max(scan_id) AS scan_id FROM runs WHERE status = 'running' GROUP BY ALL)
    SELECT volume_id, root, scan_id, CASE WHEN scan_id IS NULL THEN 'new' WHEN resume THEN 'resumed' ELSE 'superseded' END AS verdict FROM wanted LEFT JOIN last USING (volume_id, root)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    e, i = F.col("event_id"), F.col("id")
    root = lambda c, n: F.concat(F.lit("r"), (c % n).cast("string")).alias("root")
    runs = spark.read.parquet(f"{sf}/events.parquet").where("event_id < 60").select(e.alias("scan_id"), (e % 7).cast("int").alias("volume_id"), root(e, 5), F.when(e % 3 == 0, "running").otherwise("completed").alias("status"))
    return state.open_scans(runs, spark.range(42).select((i % 7).cast("int").alias("volume_id"), root(i, 6), (i % 2 == 0).alias("resume")))


@query("reset_verdict", with_files(f", {_ACTIONS} SELECT 'refused: files are in quarantine' AS verdict, count(DISTINCT batch_id) AS batches, count(*) AS files FROM acts WHERE state = 'done'"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return state.reset_verdict(_acts(spark, sf)[0])


@query(
    "run_counters",
    with_files(
        """SELECT count(*) AS present, count(partial_hash) AS probed, count(content_hash) AS hashed, count(*) FILTER (hashed_size <> size OR hashed_mtime <> mtime) AS stale,
        count(*) FILTER (decode_state = 1) AS decoded, count(*) FILTER (decode_state = 2) AS failed, count(*) FILTER (meta_state = 4) AS with_metadata FROM files WHERE present"""
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return state.run_counters(_fv(spark, sf)[0])


_METRICS = f"""{_CLUSTERS}, metrics AS (SELECT cluster, count(*) AS files, count(DISTINCT pixel_hash) = 1 AS pixel_identical, count(*) - count(DISTINCT pixel_hash) AS metadata_only, (sum(size) - max(size))::BIGINT AS reclaimable FROM full_members GROUP BY cluster)"""


@query(
    "similar_summary",
    with_prints(
        f""", {_METRICS} SELECT count(*) AS clusters, count(*) FILTER (pixel_identical) AS identical, coalesce(sum(files - 1), 0)::BIGINT AS redundant, coalesce(sum(metadata_only), 0)::BIGINT AS metadata_only,
        coalesce(sum(reclaimable), 0)::BIGINT AS reclaimable FROM metrics"""
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return state.similar_summary(similar.cluster_metrics(*_clusters(spark, sf)))


@query("similar_largest", with_prints(f", {_METRICS} SELECT cluster, files, reclaimable FROM metrics ORDER BY reclaimable DESC, cluster LIMIT 20"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return similar.cluster_metrics(*_clusters(spark, sf)).orderBy(F.desc("reclaimable"), "cluster").limit(20).select("cluster", "files", "reclaimable")


@query("similar_identical", with_prints(f", {_METRICS} SELECT cluster, files FROM metrics WHERE pixel_identical"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return similar.cluster_metrics(*_clusters(spark, sf)).where("pixel_identical").select("cluster", "files")


@query("similar_listing", with_prints(f", {_METRICS} SELECT f.file_key, f.cluster, CASE WHEN pixel_identical THEN 'identical' ELSE 'near' END AS kind, f.size, f.pixel_hash FROM full_members f JOIN metrics USING (cluster)"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    members, rows = _clusters(spark, sf)
    return state.similar_listing(members, similar.cluster_metrics(members, rows), rows).select("file_key", "cluster", "kind", "size", "pixel_hash")


@query("review_totals", with_prints(f", {_METRICS} SELECT count(*) AS confirmed, coalesce(sum(reclaimable), 0)::BIGINT AS reclaimable FROM metrics WHERE cluster % 2 = 0"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    metrics = similar.cluster_metrics(*_clusters(spark, sf))
    decisions = metrics.select("cluster", F.when(F.col("cluster") % 2 == 0, "confirmed").otherwise("skipped").alias("state"))
    return state.review_totals(decisions, metrics)


@query(
    "review_export",
    with_files(
        f""", {_PLAN}, d AS (SELECT group_key, max(file_key) AS chosen FROM plan GROUP BY group_key HAVING group_key % 3 <> 0)
        SELECT group_key, file_key, CASE WHEN file_key = chosen THEN 'Keep' ELSE 'Quarantine' END AS action, CASE WHEN file_key <> chosen THEN chosen END AS kept_file_key, size FROM plan JOIN d USING (group_key)"""
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    plan = _plan(spark, sf)
    decisions = plan.groupBy("group_key").agg(F.max("file_key").alias("keeper_file_key")).withColumn("state", F.when(F.col("group_key") % 3 != 0, "confirmed").otherwise("skipped"))
    return state.review_export(plan, decisions)


@query("plan_preview", with_files(f", {_PLAN}, n AS (SELECT dense_rank() OVER (ORDER BY group_key) AS group_no, * FROM plan) SELECT group_no, action, file_key, size FROM n WHERE group_no <= 5"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    from kinsight.operators import keeper

    return keeper.number_groups(_plan(spark, sf)).where("group_no <= 5").orderBy("group_no", "action", "file_key").select("group_no", "action", "file_key", "size")


@query("volumes_listing", with_files("SELECT volume_id, label, last_mount_point, row_number() OVER (ORDER BY last_mount_point NULLS LAST, volume_id)::INT AS place FROM volumes"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    vols = _fv(spark, sf)[1]  # twenty rows at most
    return vols.select("volume_id", "label", "last_mount_point", F.row_number().over(Window.orderBy(F.asc_nulls_last("last_mount_point"), "volume_id")).alias("place"))


@query(
    "absorbed_roots",
    r"""WITH r AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN 'D:\' || p_brand WHEN 1 THEN 'd:/' || p_brand || '/' || p_size WHEN 2 THEN 'D:\' || p_brand || '\' || p_size || '\x' || p_partkey ELSE 'E:\' || p_name END AS root FROM part),
    p AS (SELECT root, rtrim(replace(lower(root), '/', '\'), '\') AS plain FROM r), f AS (SELECT plain, min(root) AS name FROM p GROUP BY plain)
    SELECT p.root, (SELECT arg_min(f.name, length(f.plain)) FROM f WHERE (p.plain = f.plain OR starts_with(p.plain, f.plain || '\')) AND f.name <> p.root) AS absorbed_by FROM p""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    root = F.when(k % 4 == 0, F.concat(F.lit("D:\\"), "p_brand")).when(k % 4 == 1, F.concat(F.lit("d:/"), "p_brand", F.lit("/"), size))
    root = root.when(k % 4 == 2, F.concat(F.lit("D:\\"), "p_brand", F.lit("\\"), size, F.lit("\\x"), k.cast("string"))).otherwise(F.concat(F.lit("E:\\"), "p_name"))
    return state.absorb_roots(spark.read.parquet(f"{sf}/part.parquet").select(root.alias("root")))


@query(
    "path_inside",
    r"""SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN false ELSE p_partkey % 17 <= p_partkey % 13 END AS inside FROM part""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    times = lambda text, n: F.repeat(F.lit(text), n.cast("int"))
    path = F.concat(F.when(k % 5 == 4, "C:\\Quarantine-old").otherwise("c:/Quarantine"), times("\\sub", k % 13), times("/..", k % 17), F.lit("\\.\\x.jpg"))
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", names.is_inside(path, F.lit("C:\\Quarantine\\")).alias("inside"))


@query(
    "unique_names",
    r"""WITH w AS (SELECT p_partkey AS file_key, p_brand AS folder, 'n' || p_size || '.JPG' AS name FROM part), t AS (SELECT p_brand AS folder, 'N' || p_size || (CASE WHEN p_partkey % 2 = 0 THEN '' ELSE '__' || (p_partkey % 9) END) || '.jpg' AS name FROM part WHERE p_partkey % 10 < 2),
    m AS (SELECT folder, regexp_replace(lower(name), '__[0-9]+', '') AS low, max(coalesce(try_cast(nullif(regexp_extract(name, '__([0-9]+)', 1), '') AS BIGINT), 0)) AS most FROM t GROUP BY ALL),
    o AS (SELECT w.*, coalesce(most + 1, 0) + row_number() OVER (PARTITION BY w.folder, w.name ORDER BY file_key) - 1 AS n FROM w LEFT JOIN m ON m.folder = w.folder AND m.low = lower(w.name))
    SELECT file_key, CASE WHEN n = 0 THEN name ELSE replace(name, '.JPG', '') || '__' || n || '.JPG' END AS name FROM o""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    part, k, size = spark.read.parquet(f"{sf}/part.parquet"), F.col("p_partkey"), F.col("p_size").cast("string")
    wanted = part.select(k.alias("file_key"), F.col("p_brand").alias("folder"), F.concat(F.lit("n"), size, F.lit(".JPG")).alias("name"))
    marks = F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("__"), (k % 9).cast("string")))
    return state.unique_names(wanted, part.where("p_partkey % 10 < 2").select(F.col("p_brand").alias("folder"), F.concat(F.lit("N"), size, marks, F.lit(".jpg")).alias("name")))


@query(
    "settings",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 14 WHEN 2 THEN 14 ELSE 30 END AS retention_days, CASE p_partkey % 4 WHEN 0 THEN 'd:' WHEN 3 THEN NULL END AS quarantine_drive FROM part""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    texts = ('{"retentionDays": 3, "quarantineDrive": "d:"}', '{"retentionDays": 0}', "not a settings text", '{"retentionDays": 30, "quarantineDrive": "Q:"}')
    text = F.element_at(F.array(*map(F.lit, texts)), (1 + F.col("p_partkey") % 4).cast("int"))
    found = state.settings(text, ["C:", "D:"])
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", found["retention_days"].alias("retention_days"), found["quarantine_drive"].alias("quarantine_drive"))


@query(
    "folder_labels",
    with_files(r"""SELECT file_key, CASE WHEN file_key % 2 = 0 THEN '...\' || source || '\' || folder || '\' || name ELSE lang || '\' || source || '\' || folder END AS label FROM files"""),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = F.when(_k() % 2 == 0, F.col("rel_path")).otherwise(F.regexp_replace("rel_path", r"\\[^\\]*$", ""))
    return _fv(spark, sf)[0].select("file_key", names.folder_label(path).alias("label"))
