"""Queries over the derived catalog, and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsight.functions import bits, metadata, names
from kinsight.operators import actions, exact, keeper, reports, scope, similar
from kinsight.plans.oracle_ctes import with_files, with_prints
from kinsight.sources import catalog
from kinsight.storage import stored
from kinsight.streaming import ingest

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def _fv(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return catalog.files(spark, sf), catalog.volumes(spark, sf)


# ---- exact duplicates ----------------------------------------------------

_COLLIDING = """
hashed AS (SELECT * FROM files WHERE present AND content_hash IS NOT NULL),
c1 AS (SELECT * FROM hashed WHERE size IN (SELECT size FROM hashed GROUP BY size HAVING count(*) > 1)),
c2 AS (SELECT * FROM c1 WHERE (size, partial_hash) IN (SELECT (size, partial_hash) FROM c1 GROUP BY size, partial_hash HAVING count(*) > 1)),
groups AS (
  SELECT size, content_hash, count(*) AS entries,
         count(DISTINCT CASE WHEN file_id_low IS NOT NULL THEN 'id:' || volume_id || ':' || file_id_low ELSE 'path:' || volume_id || ':' || lower(rel_path) END) AS copies,
         bool_or(NOT attached) AS touches_offline, min(file_key) AS first_key
  FROM c2 JOIN volumes USING (volume_id) GROUP BY size, content_hash),
dups AS (SELECT *, entries - copies AS hardlinked, size * (copies - 1) AS reclaimable FROM groups WHERE copies >= 2)
"""


@query("exact_duplicate_groups", with_files(f", {_COLLIDING} SELECT * FROM dups"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return exact.groups(*_fv(spark, sf))


@query(
    "exact_duplicate_summary",
    with_files(
        f""", {_COLLIDING} SELECT count(*) AS n_groups, coalesce(sum(copies - 1), 0)::BIGINT AS redundant, coalesce(sum(reclaimable), 0)::BIGINT AS reclaimable,
        coalesce(sum(hardlinked), 0)::BIGINT AS hardlinked, count(*) FILTER (touches_offline) AS offline_groups FROM dups WHERE size >= 100"""
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return exact.summary(exact.groups(*_fv(spark, sf)), 100)


@query("exact_top_k", with_files(f", {_COLLIDING} SELECT content_hash, size, copies, reclaimable FROM dups ORDER BY reclaimable DESC, content_hash LIMIT 20"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return exact.groups(*_fv(spark, sf)).orderBy(F.desc("reclaimable"), "content_hash").limit(20).select("content_hash", "size", "copies", "reclaimable")


@query(
    "exact_duplicate_listing",
    with_files(f", {_COLLIDING} SELECT f.file_key, f.rel_path, f.content_hash, f.size, d.reclaimable FROM files f JOIN dups d ON f.size = d.size AND f.content_hash = d.content_hash WHERE f.present"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    files, vols = _fv(spark, sf)
    return exact.members(files, exact.groups(files, vols)).select("file_key", "rel_path", "content_hash", "size", "reclaimable")


@query(
    "cascade_cost",
    with_files(
        """, s AS (SELECT size, count(*) AS n, sum(size) AS bytes, sum(least(size, 131072)) AS probe FROM files WHERE present GROUP BY size)
        SELECT coalesce(sum(n), 0)::BIGINT AS files, coalesce(sum(bytes), 0)::BIGINT AS bytes, count(*) FILTER (n > 1) AS size_groups,
        coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS candidates, coalesce(sum(bytes) FILTER (n > 1), 0)::BIGINT AS candidate_bytes,
        coalesce(sum(probe) FILTER (n > 1), 0)::BIGINT AS probe_bytes FROM s"""
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return exact.cascade_cost(catalog.files(spark, sf))


@query(
    "unhashed_candidates",
    with_files(
        """ SELECT count(*) FILTER (content_hash IS NULL) AS unhashed FROM files WHERE present
        AND size IN (SELECT size FROM files WHERE present GROUP BY size HAVING count(*) > 1)"""
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return exact.unhashed(catalog.files(spark, sf))


# ---- statistics ----------------------------------------------------------


@query(
    "stats_by_volume",
    with_files(
        """ SELECT v.volume_id, coalesce(last_mount_point, volume_guid) AS volume, count(*) FILTER (present) AS files,
        coalesce(sum(size) FILTER (present), 0)::BIGINT AS bytes, count(*) FILTER (NOT present) AS missing
        FROM volumes v LEFT JOIN files f ON v.volume_id = f.volume_id GROUP BY ALL"""
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return reports.by_volume(*_fv(spark, sf))


@query(
    "catalogued_by_volume",
    with_files(
        """ SELECT v.volume_id, count(f.file_key) AS files, coalesce(sum(f.size), 0)::BIGINT AS bytes
        FROM volumes v LEFT JOIN files f ON v.volume_id = f.volume_id AND f.present AND f.size > 5000 GROUP BY v.volume_id"""
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    files, vols = _fv(spark, sf)
    return reports.by_volume(files.where("present and size > 5000"), vols).select("volume_id", "files", "bytes")


@query("stats_by_ext", with_files(" SELECT coalesce(ext, '(none)') AS ext, count(*) AS files, sum(size)::BIGINT AS bytes FROM files WHERE present GROUP BY 1 ORDER BY bytes DESC, 1 LIMIT 12"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return reports.by_extension(catalog.files(spark, sf))


_FOLDERS = r"""
ranked AS (SELECT f.*, min(file_key) OVER (PARTITION BY content_hash) AS c0, min(file_key) OVER (PARTITION BY pixel_hash) AS p0,
           array_to_string(string_split(rel_path, '\')[1:least(3, len(string_split(rel_path, '\')) - 1)], '\') AS fold FROM files f WHERE present),
marked AS (SELECT *, content_hash IS NOT NULL AND file_key > c0 AS exact, NOT (content_hash IS NOT NULL AND file_key > c0) AND pixel_hash IS NOT NULL AND file_key > p0 AS picture FROM ranked),
folders AS (SELECT volume_id, lower(fold) AS folder_key, min(fold) AS folder, count(*) AS files, sum(size)::BIGINT AS bytes,
  count(*) FILTER (exact) AS exact_files, coalesce(sum(size) FILTER (exact), 0)::BIGINT AS exact_bytes,
  count(*) FILTER (picture) AS picture_files, coalesce(sum(size) FILTER (picture), 0)::BIGINT AS picture_bytes FROM marked GROUP BY 1, 2),
report AS (SELECT *, exact_bytes + picture_bytes AS reclaimable, CASE WHEN exact_bytes + picture_bytes = 0 THEN 1.0::DOUBLE ELSE exact_bytes::DOUBLE / (exact_bytes + picture_bytes) END AS provable_share,
  (exact_files + picture_files)::DOUBLE / files AS redundant_share FROM folders)
"""


@query("folder_report", with_files(f", {_FOLDERS} SELECT * FROM report WHERE reclaimable > 0 ORDER BY reclaimable DESC, volume_id, folder_key LIMIT 25"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return reports.top_folders(reports.folders(catalog.files(spark, sf)))


@query(
    "folder_safest",
    with_files(f", {_FOLDERS} SELECT volume_id, folder, exact_bytes, provable_share FROM report WHERE provable_share >= 0.9 AND exact_bytes > 1000 ORDER BY exact_bytes DESC, volume_id, folder_key LIMIT 1"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return reports.safest_folder(reports.folders(catalog.files(spark, sf)), least_bytes=1000).select("volume_id", "folder", "exact_bytes", "provable_share")


# ---- scopes and crawling -------------------------------------------------


@query(
    "scope_filter",
    with_files(
        r""" SELECT file_key, rel_path FROM files JOIN volumes USING (volume_id) WHERE coalesce(((lower(last_mount_point) LIKE 'c:%' AND starts_with(lower(rel_path), 'en\src2\set'))
        OR starts_with(lower(rel_path), 'fr\src')) AND NOT contains(lower(rel_path), 'backup'), false)"""
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    files, vols = _fv(spark, sf)
    return scope.in_scope(files, vols, scope.Scope(under=("C:\\en\\src2\\set", "fr\\SRC"), exclude=("X:\\Backup",))).select("file_key", "rel_path")


@query(
    "crawl_filter",
    with_files(
        r""" SELECT file_key, CASE WHEN list_contains(string_split(lower(rel_path), '\'), 'appdata') THEN 'excluded folder' WHEN contains(lower(rel_path), 'whatsapp') THEN 'excluded path'
        WHEN ext = '.txt' THEN 'extension' WHEN size < 500 THEN 'too small' WHEN attributes & 4096 <> 0 THEN 'cloud placeholder' WHEN attributes & 2 <> 0 THEN 'hidden' END AS refused FROM files"""
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.files(spark, sf).select("file_key", scope.refusal(scope.Crawl(min_size=500, fragments=("whatsapp",))).alias("refused"))


@query(
    "scan_targets",
    with_files(
        """ SELECT volume_id, reason, reason = '' AS recommended FROM (SELECT volume_id, CASE WHEN last_mount_point IS NULL THEN 'no drive letter or mount point'
        WHEN storage_kind = 'Remote' THEN 'network drive' WHEN contains(lower(label), 'google drive') THEN 'cloud sync drive' WHEN total_bytes < 2147483648 THEN 'smaller than 2 GB' ELSE '' END AS reason FROM volumes)"""
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return scope.scan_targets(catalog.volumes(spark, sf)).select("volume_id", "reason", "recommended")


@query("owning_volume", with_files(r" SELECT file_key, CASE WHEN last_mount_point IS NOT NULL THEN volume_id END AS volume_id FROM files JOIN volumes USING (volume_id)"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    files, vols = _fv(spark, sf)
    mounted = files.join(F.broadcast(vols.select("volume_id", "last_mount_point")), "volume_id")
    paths = mounted.select("file_key", names.full_path(F.coalesce("last_mount_point", F.lit("?:\\")), F.col("rel_path")).alias("path"))
    return scope.owning_volume(paths, vols).select("file_key", "volume_id")


@query(
    "stale_rows",
    with_files(""" SELECT file_key, (partial_hash IS NULL OR hashed_size <> size OR hashed_mtime <> mtime) AS rehash, decode_state = 0 OR decode_state = 2 AS redecode, meta_state < 4 AS reread FROM files"""),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.files(spark, sf).select("file_key", scope.stale_hash().alias("rehash"), scope.undecoded(True).alias("redecode"), scope.unread_metadata().alias("reread"))


@query(
    "mark_missing",
    with_files(r""" SELECT file_key, CASE WHEN volume_id = 0 AND last_scan_id <> 2 AND (lower(rel_path) = 'en\src0' OR starts_with(lower(rel_path), 'en\src0\')) THEN false ELSE present END AS present FROM files"""),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return scope.mark_missing(catalog.files(spark, sf), 0, 2, "en\\src0").select("file_key", "present")


@query(
    "merge_catalog",
    with_files(
        r""", old AS (SELECT * FROM files WHERE file_key % 5 <> 0), seen AS (SELECT volume_id, rel_path, size + 1 AS size FROM files WHERE file_key % 3 = 0),
        fresh AS (SELECT volume_id, rel_path, 1000000 + row_number() OVER (ORDER BY volume_id, rel_path) - 1 AS k FROM seen s WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.volume_id = s.volume_id AND o.rel_path = s.rel_path))
        SELECT coalesce(o.file_key, f.k) AS file_key, coalesce(o.volume_id, s.volume_id) AS volume_id, coalesce(o.rel_path, s.rel_path) AS rel_path, coalesce(s.size, o.size) AS size,
        s.size IS NOT NULL OR coalesce(o.present, false) AS present, o.content_hash
        FROM old o FULL JOIN seen s ON o.volume_id = s.volume_id AND o.rel_path = s.rel_path LEFT JOIN fresh f ON f.volume_id = s.volume_id AND f.rel_path = s.rel_path"""
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    files = catalog.files(spark, sf)
    seen = files.where("file_key % 3 = 0").select("volume_id", "rel_path", (F.col("size") + 1).alias("size"))
    return scope.merge_catalog(files.where("file_key % 5 <> 0"), seen, 1_000_000).select("file_key", "volume_id", "rel_path", "size", "present", "content_hash")


# ---- near duplicates -----------------------------------------------------

_ROWS = "r AS (SELECT f.*, p.dhash, p.phash, p.thumb16, p.contrast FROM files f JOIN prints p USING (file_key) WHERE present AND decode_state = 1)"
_NEAR = f"""
{_ROWS}, s AS (SELECT *, regexp_extract(regexp_replace(name, '\\.[^.]*$', ''), '^(.*?)([0-9]{{2,6}})$', 1) AS prefix,
       regexp_extract(regexp_replace(name, '\\.[^.]*$', ''), '^(.*?)([0-9]{{2,6}})$', 2) AS number FROM r WHERE contrast >= 6.0),
raw AS (SELECT a.file_key AS i, b.file_key AS j, least(bit_count(xor(a.dhash, b.dhash)), bit_count(xor(a.phash, b.phash)))::INT AS hamming, a.thumb16 AS ta, b.thumb16 AS tb,
  CASE WHEN a.date_taken IS NOT NULL AND b.date_taken IS NOT NULL
       THEN a.date_taken <> b.date_taken OR coalesce(a.sub_sec <> b.sub_sec, false)
       ELSE a.prefix <> '' AND a.number <> '' AND b.number <> '' AND lower(a.prefix) = lower(b.prefix) AND a.number <> b.number END AS separate
  FROM s a JOIN s b ON a.file_key < b.file_key WHERE least(bit_count(xor(a.dhash, b.dhash)), bit_count(xor(a.phash, b.phash))) <= 4),
stats AS (SELECT *, list_avg(ta) AS ma, list_avg(tb) AS mb, list_stddev_pop(ta) AS sa, list_stddev_pop(tb) AS sb FROM raw),
near AS (SELECT i, j, hamming, separate,
  list_avg(list_transform(list_zip(ta, tb), lambda z: abs(z[1] - ((z[2] - mb) * (CASE WHEN sb < 1e-6 THEN 1.0 ELSE sa / sb END) + ma)))) AS thumbnail FROM stats)
"""
_ALL = similar.Similarity(max_bucket=None)


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return stored(similar.usable(catalog.files(spark, sf), catalog.prints(spark, sf)), "rows")


@query(
    "band_candidates",
    with_prints(
        f""", {_ROWS}, k AS (SELECT file_key, kind, band, (h >> off) & ((1::BIGINT << w) - 1) AS key FROM
        (SELECT file_key, 0 AS kind, dhash AS h FROM r UNION ALL SELECT file_key, 1, phash FROM r),
        (VALUES (0, 0, 13), (1, 13, 13), (2, 26, 13), (3, 39, 13), (4, 52, 12)) b(band, off, w))
        SELECT DISTINCT a.file_key AS i, b.file_key AS j FROM k a JOIN k b ON a.kind = b.kind AND a.band = b.band AND a.key = b.key AND a.file_key < b.file_key"""
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return similar.candidate_pairs(_rows(spark, sf), _ALL)


@query("similar_pairs", with_prints(f", {_NEAR} SELECT i, j, hamming, round(thumbnail, 6) AS thumbnail, separate, NOT separate AND thumbnail <= 8.0 AS confirmed FROM near"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return similar.near_pairs(_rows(spark, sf), _ALL).withColumn("thumbnail", F.round("thumbnail", 6))


@query("hamming_histogram", with_prints(f", {_NEAR} SELECT c.cell, count(n.i) AS n FROM (SELECT unnest(range(65)) AS cell) c LEFT JOIN near n ON n.hamming = c.cell GROUP BY 1"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return similar.histogram(similar.near_pairs(_rows(spark, sf), _ALL), "hamming", 65)


@query(
    "thumbnail_histogram",
    with_prints(f", {_NEAR} SELECT c.cell, count(n.i) AS n FROM (SELECT unnest(range(64)) AS cell) c LEFT JOIN near n ON least(floor(n.thumbnail), 63) = c.cell GROUP BY 1"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return similar.histogram(similar.near_pairs(_rows(spark, sf), _ALL), "thumbnail", 64)


@query(
    "calibration",
    with_prints(
        f""", {_NEAR}, cells AS (SELECT c.cell, count(n.i) AS n FROM (SELECT unnest(range(64)) AS cell) c LEFT JOIN near n ON NOT n.separate AND least(floor(n.thumbnail), 63) = c.cell GROUP BY 1)
        SELECT cell, n, repeat('#', CASE WHEN max(n) OVER () > 0 THEN (n * 40 // max(n) OVER ())::INT ELSE 0 END) AS bar, CASE WHEN cell < 8 THEN 'keep' ELSE 'drop' END AS verdict FROM cells"""
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return similar.calibration(similar.near_pairs(_rows(spark, sf), _ALL))


_CLUSTERS = f"""
{_NEAR}, pic AS (SELECT file_key AS u, min(file_key) OVER (PARTITION BY pixel_hash) AS v FROM r WHERE pixel_hash IS NOT NULL),
edges AS (SELECT u, v FROM pic WHERE u <> v UNION SELECT i, j FROM near WHERE NOT separate AND thumbnail <= 8.0),
both_ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reach AS (SELECT u AS node, u AS other FROM both_ways UNION SELECT reach.node, b.v FROM reach JOIN both_ways b ON reach.other = b.u),
comp AS (SELECT node AS file_key, min(other) AS cluster FROM reach GROUP BY node),
own AS (SELECT comp.*, r.date_taken, r.sub_sec, r.pixel_hash, r.size, r.img_width, r.img_height, CASE WHEN r.date_taken IS NOT NULL THEN r.date_taken || ':' || coalesce(r.sub_sec, -1) END AS moment FROM comp JOIN r USING (file_key)),
moments AS (SELECT cluster, count(DISTINCT moment) AS m FROM own GROUP BY cluster),
borrowed AS (SELECT cluster, pixel_hash, arg_min(moment, file_key) AS b FROM own WHERE moment IS NOT NULL GROUP BY ALL),
parts AS (SELECT file_key, own.cluster, CASE WHEN m <= 1 THEN 'all' ELSE coalesce(moment, b, 'alone:' || file_key) END AS part
          FROM own JOIN moments USING (cluster) LEFT JOIN borrowed ON own.cluster = borrowed.cluster AND own.pixel_hash = borrowed.pixel_hash),
members AS (SELECT * FROM (SELECT file_key, min(file_key) OVER w AS cluster, count(*) OVER w AS n FROM parts WINDOW w AS (PARTITION BY cluster, part)) WHERE n > 1),
full_members AS (SELECT m.file_key, m.cluster, r.pixel_hash, r.size, r.img_width, r.img_height FROM members m JOIN r USING (file_key))
"""


def _clusters(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = _rows(spark, sf)
    return similar.clusters(rows, _ALL), rows


@query("clusters", with_prints(f", {_CLUSTERS} SELECT file_key, cluster FROM members"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _clusters(spark, sf)[0]


@query(
    "cluster_metrics",
    with_prints(
        f""", {_CLUSTERS} SELECT cluster, count(*) AS files, count(DISTINCT pixel_hash) = 1 AS pixel_identical, count(*) - count(DISTINCT pixel_hash) AS metadata_only,
        (sum(size) - max(size))::BIGINT AS reclaimable, max(img_width::BIGINT * img_height) AS max_pixels FROM full_members GROUP BY cluster"""
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return similar.cluster_metrics(*_clusters(spark, sf))


@query(
    "pixel_groups",
    with_prints(
        f""", {_CLUSTERS}, g AS (SELECT cluster, pixel_hash, count(*) AS files, max(size) AS largest, min(file_key) AS first_key FROM full_members GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY files DESC, largest DESC, first_key)::INT AS rank FROM g"""
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return similar.pixel_groups(*_clusters(spark, sf))


@query("cluster_key", with_prints(f", {_CLUSTERS} SELECT cluster, left(sha256(string_agg(file_key::VARCHAR, ',' ORDER BY file_key) || ','), 32) AS cluster_key FROM members GROUP BY cluster"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return similar.cluster_keys(_clusters(spark, sf)[0])


@query("collapse_identical")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return similar.collapse_identical(_rows(spark, sf))


@query(
    "similarity_totals",
    with_prints(
        f""", {_NEAR} SELECT * FROM (SELECT count(*) AS decoded, count(DISTINCT (dhash, phash)) AS distinct_prints, count(*) FILTER (contrast < 6.0) AS held_back, count(date_taken) AS with_time FROM r),
        (SELECT count(*) AS near, count(*) FILTER (NOT separate AND thumbnail <= 8) AS confirmed, count(*) FILTER (separate) AS separate, count(*) FILTER (NOT separate AND thumbnail > 8) AS too_far FROM near)"""
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf)
    return similar.totals(rows, similar.near_pairs(rows, _ALL))


# ---- keeper and plan -----------------------------------------------------

_SCORED = r"""
named AS (SELECT f.*, regexp_replace(name, '\.[^.]*$', '') AS st, '\' || lower(rel_path) AS low, attached, volume_guid, file_system,
          CASE ext WHEN '.nef' THEN 3 WHEN '.png' THEN 2 WHEN '.jpg' THEN 1 ELSE 0 END AS tier, img_width::BIGINT * img_height AS pixels FROM files f JOIN volumes USING (volume_id)),
flags AS (SELECT *, contains(low, '\backup') OR contains(low, ' - copy') AS demoted, contains(low, 'set3') AS preferred,
          regexp_matches(st, '(?i)^(img|dsc|dscn|photo|image|picture|untitled|unnamed|download|screenshot|received|fb_img|whatsapp|zalo|viber|scan|capture|_mg)[-_ ]?[0-9]*') AS generic,
          regexp_matches(st, '(?i)(\([0-9]+\)|[-_ ]cop(y|ia)|[-_ ][0-9]+\s*-\s*cop(y|ia))$') AS copied FROM named),
scored AS (SELECT *, ((CASE WHEN preferred THEN 100 ELSE 0 END) + (CASE WHEN demoted THEN -60 ELSE 0 END) - 2 * least(length(rel_path) - length(replace(rel_path, '\', '')), 12)
           + (CASE WHEN generic THEN 0 ELSE 30 END) + (CASE WHEN copied THEN -40 ELSE 0 END) - 5)::INT AS score,
  concat_ws('; ', CASE WHEN date_taken IS NOT NULL THEN 'capture date ' || strftime(make_timestamp(date_taken * 1000000), '%Y-%m-%d') WHEN has_exif THEN 'EXIF but no capture date' ELSE 'NO metadata' END,
    CASE WHEN jpeg_quality >= 90 THEN 'quality ~' || jpeg_quality WHEN jpeg_quality <= 70 THEN 're-compressed ~' || jpeg_quality END,
    CASE WHEN preferred THEN 'in a preferred folder' END, CASE WHEN demoted THEN 'in a scratch/backup folder' END,
    CASE WHEN NOT generic THEN 'descriptive filename' END, CASE WHEN copied THEN 'looks like a copy' END) AS reasons FROM flags)
"""
_ORDER = """(CASE WHEN pixels * 1.2 >= mp THEN mp ELSE pixels END) DESC, (date_taken IS NOT NULL) DESC, tier DESC, (CASE WHEN (mt - exif_tags) * 4 <= mt THEN mt ELSE exif_tags END) DESC,
  (CASE WHEN jpeg_quality IS NULL OR mq - jpeg_quality <= 5 THEN mq ELSE jpeg_quality END) DESC NULLS LAST, score DESC, lower(rel_path), file_key"""
_POLICY = keeper.Policy(preferred=("set3",))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    files, vols = _fv(spark, sf)
    return keeper.scored(files, _POLICY).join(F.broadcast(vols.select("volume_id", "attached")), "volume_id")


def _ranked_sql(group: str, source: str) -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {_ORDER})::INT AS rank FROM (SELECT *, max(pixels) OVER w AS mp, max(exif_tags) OVER w AS mt, max(jpeg_quality) OVER w AS mq FROM {source} WINDOW w AS (PARTITION BY {group})))"


@query("keeper_score", with_files(f", {_SCORED} SELECT file_key, score FROM scored"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("file_key", "score")


@query("keeper_reasons", with_files(f", {_SCORED} SELECT file_key, reasons FROM scored"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("file_key", "reasons")


@query("keeper_rank_window", with_files(f", {_SCORED} SELECT pixel_hash, file_key, rank FROM {_ranked_sql('pixel_hash', 'scored')}"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return keeper.rank_by_band(_scored(spark, sf), "pixel_hash").select("pixel_hash", "file_key", "rank")


@query("keeper_rank_exact")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return keeper.rank_pairwise(_scored(spark, sf), "pixel_hash")


_PLAN = f"""
{_SCORED}, phys AS (SELECT *, CASE WHEN file_id_low IS NOT NULL THEN 'id:' || volume_id || ':' || file_id_low ELSE 'path:' || volume_id || ':' || lower(rel_path) END AS ph FROM scored WHERE present AND content_hash IS NOT NULL),
one AS (SELECT * FROM (SELECT *, min(file_key) OVER (PARTITION BY pixel_hash, ph) AS f0 FROM phys) WHERE file_key = f0),
grp AS (SELECT * FROM (SELECT *, count(*) OVER w AS n, bool_or(NOT attached) OVER w AS offline, min(file_key) OVER w AS group_key FROM one WINDOW w AS (PARTITION BY pixel_hash, tier)) WHERE n > 1 AND NOT offline),
rk AS (SELECT * FROM {_ranked_sql('group_key', 'grp')}),
kp AS (SELECT group_key, file_key AS kf, tier AS ktier, pixels AS kpix, exif_tags AS ktags, date_taken AS kdate, jpeg_quality AS kq FROM rk WHERE rank = 1),
gain AS (SELECT group_key, sum(size) AS gain FROM rk WHERE rank > 1 GROUP BY group_key HAVING sum(size) >= 1),
plan AS (SELECT rk.group_key, 'IdenticalPicture' AS kind, CASE WHEN rank = 1 THEN 'Keep' ELSE 'Quarantine' END AS action, file_key, CASE WHEN rank > 1 THEN kf END AS kept_file_key, score, size, exif_tags, date_taken,
  jpeg_quality, img_width, img_height, volume_id, volume_guid, file_system, rel_path, pixel_hash, content_hash, offline, file_id_low, ktags, kdate,
  CASE WHEN rank = 1 THEN reasons ELSE coalesce(nullif(concat_ws('; ', CASE WHEN tier > ktier THEN 'x' END,
    CASE WHEN pixels < kpix THEN 'lower resolution (' || img_width || 'x' || img_height || ')' END, CASE WHEN exif_tags < ktags THEN 'less metadata' END,
    CASE WHEN exif_tags > ktags THEN 'MORE metadata than keeper' END, CASE WHEN date_taken IS NOT NULL AND kdate IS NULL THEN 'HAS capture date, keeper does not' END,
    CASE WHEN jpeg_quality < kq THEN 'lower quality (~' || jpeg_quality || ')' END), ''), 'duplicate of keeper') END AS reason
  FROM rk JOIN kp USING (group_key) JOIN gain USING (group_key))
"""


def _plan(spark: SparkSession, sf: str) -> DataFrame:
    return keeper.build_plan(_scored(spark, sf).where("present and content_hash is not null"), "pixel_hash", "IdenticalPicture")


@query(
    "plan_rows",
    with_files(f", {_PLAN} SELECT dense_rank() OVER (ORDER BY group_key) AS group_no, group_key, kind, action, file_key, kept_file_key, score, size, reason FROM plan"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return keeper.number_groups(_plan(spark, sf)).select("group_no", "group_key", "kind", "action", "file_key", "kept_file_key", "score", "size", "reason")


@query(
    "plan_summary",
    with_files(
        f""", {_PLAN}, g AS (SELECT group_key, count(*) FILTER (action = 'Quarantine') AS goes, sum(size) FILTER (action = 'Quarantine') AS bytes, bool_or(offline) AS offline,
        bool_or(action = 'Quarantine' AND (exif_tags > ktags OR (date_taken IS NOT NULL AND kdate IS NULL))) AS poorer FROM plan GROUP BY group_key)
        SELECT count(*) AS n_groups, count(*) AS keep, coalesce(sum(goes), 0)::BIGINT AS quarantine, coalesce(sum(bytes), 0)::BIGINT AS reclaimable, count(*) FILTER (offline) AS offline_groups, count(*) FILTER (poorer) AS poorer_groups FROM g"""
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return keeper.plan_summary(_plan(spark, sf))


@query("plan_loss_reasons", with_files(f", {_PLAN} SELECT reason, count(*) AS n FROM plan WHERE action = 'Quarantine' GROUP BY reason"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _plan(spark, sf).where("action = 'Quarantine'").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# ---- names and metadata --------------------------------------------------


@query(
    "series_guard",
    with_files(
        r""", s AS (SELECT file_key, volume_id, regexp_extract(regexp_replace(name, '\.[^.]*$', ''), '^(.*?)([0-9]{2,6})$', 1) AS prefix, regexp_extract(regexp_replace(name, '\.[^.]*$', ''), '^(.*?)([0-9]{2,6})$', 2) AS number FROM files)
        SELECT a.file_key AS i, b.file_key AS j, a.prefix <> '' AND a.number <> '' AND b.number <> '' AND lower(a.prefix) = lower(b.prefix) AND a.number <> b.number AS separate FROM s a JOIN s b ON b.file_key = a.file_key + 6"""
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    own = catalog.files(spark, sf).select("file_key", names.series(F.col("name")).alias("s"))
    other = own.select((F.col("file_key") - 6).alias("i"), F.col("file_key").alias("j"), F.col("s").alias("t"))
    return own.join(other, F.col("file_key") == F.col("i")).select("i", "j", names.different_frames(F.col("s"), F.col("t")).alias("separate"))


_NOW = "2026-01-01 00:00:00"


@query(
    "filename_dates",
    with_files(
        r""", m AS (SELECT file_key, CASE WHEN regexp_matches(name, '(?i)(?:IMG|VID|PANO|MVIMG)[_-]([0-9]{8})[_-]([0-9]{6})') THEN try_strptime(regexp_extract(name, '(?i)IMG[_-]([0-9]{8})[_-]([0-9]{6})', 1) || regexp_extract(name, '(?i)IMG[_-]([0-9]{8})[_-]([0-9]{6})', 2), '%Y%m%d%H%M%S') END AS t FROM files)
        SELECT file_key, strftime(t, '%Y-%m-%d %H:%M:%S') AS taken, CASE WHEN t IS NOT NULL THEN 'android-camera' END AS pattern FROM m"""
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    facts = names.filename_facts(F.col("name"), _NOW)
    return catalog.files(spark, sf).select("file_key", facts.alias("f")).select("file_key", F.date_format("f.taken", "yyyy-MM-dd HH:mm:ss").alias("taken"), "f.pattern")


@query("source_hints", with_files(r""" SELECT file_key, CASE WHEN contains(rel_path, '\WhatsApp\') THEN 'Messaging' WHEN file_key % 6 = 2 THEN 'Camera' ELSE 'Unknown' END AS source FROM files"""))
def _(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.files(spark, sf).select("file_key", names.filename_facts(F.col("rel_path"), _NOW)["source"].alias("source"))


@query(
    "takeout_json",
    """SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN nullif((props->>'$.k')::BIGINT, 0) ELSE 1000 + event_id END AS taken, event_id % 5 = 0 AS has_gps, event_type AS description FROM events""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    k = F.get_json_object("props", "$.k")
    k = F.when(F.col("event_id") % 3 != 0, k).otherwise("0")
    json = F.concat(
        F.lit('{"photoTakenTime":{"timestamp":"'), k, F.lit('"},"creationTime":{"timestamp":"'), F.when(F.col("event_id") % 3 == 0, (1000 + F.col("event_id")).cast("string")).otherwise("0"),
        F.lit('"},"geoData":{"latitude":'), F.when(F.col("event_id") % 5 == 0, "1.5").otherwise("0.0"), F.lit(',"longitude":0.0},"description":"'), "event_type", F.lit('"}'),
    )
    return e.select("event_id", metadata.takeout_facts(json).alias("f")).select("event_id", "f.*")


@query(
    "xmp_dates",
    r"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 2 THEN 'created' END AS taken, event_id % 4 = 1 AS has_gps FROM events""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('<rdf:Description exif:DateTimeOriginal="'), at, F.lit('" xmp:CreateDate="created"/>')))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit("<photoshop:DateCreated>"), at, F.lit("</photoshop:DateCreated><exif:GPSLatitude>1</exif:GPSLatitude>")))
        .when(F.col("event_id") % 4 == 2, F.lit('<x xmp:CreateDate="created"/>'))
        .otherwise("<x/>")
    )
    return e.select("event_id", metadata.xmp_facts(text).alias("f")).select("event_id", "f.*")


@query(
    "camera_name",
    """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_brand WHEN p_partkey % 5 = 1 THEN p_name WHEN p_partkey % 5 = 2 THEN p_brand || ' ' || p_name ELSE p_name || ' ' || p_brand END AS camera FROM part""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    p = spark.read.parquet(f"{sf}/part.parquet")
    k = F.col("p_partkey") % 5
    make = F.when(k == 0, F.col("p_brand")).when(k == 2, F.upper("p_brand")).when(k >= 3, F.col("p_name"))
    model = F.when(k == 1, F.col("p_name")).when(k == 2, F.concat_ws(" ", "p_brand", "p_name")).when(k >= 3, F.col("p_brand"))
    return p.select("p_partkey", names.camera(make, model).alias("camera"))


@query("image_fingerprints")
def _(spark: SparkSession, sf: str) -> DataFrame:
    from kinsight.functions.images import fingerprint

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    gray = F.transform(F.sequence(F.lit(0), F.lit(4095)), lambda i: F.pmod(F.xxhash64(F.col("doc_id") % 50, F.shiftright(i, 9), F.shiftright(i.bitwiseAND(F.lit(63)), 3)), F.lit(256)).cast("smallint"))
    return docs.select("doc_id", fingerprint(gray, F.lit(4000), F.lit(3000)).alias("f")).select("doc_id", "f.*")


@query("difference_maps")
def _(spark: SparkSession, sf: str) -> DataFrame:
    from kinsight.functions.images import difference_map

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id")
    cell = lambda i: F.pmod(F.xxhash64(F.col("doc_id"), F.shiftright(i, 8), F.shiftright(i.bitwiseAND(F.lit(31)), 2)), F.lit(256))
    a = F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda i: cell(i).cast("smallint"))
    b = F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda i: F.when((i < 96) & (F.col("doc_id") % 2 == 0), 255 - cell(i)).otherwise(cell(i)).cast("smallint"))
    rows = docs.select("doc_id", a.alias("a"), b.alias("b"), F.lit(32).alias("w"), F.lit(32).alias("h"))
    return difference_map(rows, "a", "b", "w", "h").drop("a", "b", "w", "h")


# ---- actions and review --------------------------------------------------


@query(
    "apply_dry_run",
    with_files(
        f""", {_PLAN}, here AS (SELECT file_key, pixel_hash AS px FROM files WHERE file_key % 10 <> 3)
        SELECT q.file_key, q.kept_file_key, q.kind, o.outcome, CASE WHEN outcome = 'would move' THEN q.size ELSE 0 END AS bytes_freed FROM plan q LEFT JOIN here v ON v.file_key = q.file_key LEFT JOIN here k ON k.file_key = q.kept_file_key,
        LATERAL (SELECT CASE WHEN v.file_key IS NULL THEN 'gone since the scan' WHEN k.file_key IS NULL THEN 'keeper missing' WHEN q.file_key % 7 = 1 THEN 'verification failed: pixels differ' ELSE 'would move' END AS outcome) o WHERE q.action = 'Quarantine'"""
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    now = catalog.files(spark, sf).where("file_key % 10 <> 3")
    plan = _plan(spark, sf)
    # files of a plan whose content is not what it was: their keepers have none of these keys
    keys = plan.where("action = 'Quarantine' and file_key % 7 = 1").select("file_key", F.lit(True).alias("edited"))
    now = now.join(keys, "file_key", "left").withColumn("pixel_hash", F.when(F.col("edited"), F.lit("edited")).otherwise(F.col("pixel_hash")))
    return actions.apply_dry_run(plan, now)


_ACTIONS = r"""
acts AS (SELECT f.file_key AS action_id, 'b' || (f.file_key % 5) AS batch_id, f.file_key, volume_guid AS origin_volume, rel_path AS origin_rel,
  (CASE WHEN f.file_key % 23 = 0 THEN 'C:\Elsewhere\' ELSE 'C:\Quarantine\' END) || rel_path AS destination, size, CASE WHEN f.file_key % 4 = 3 THEN 'undone' ELSE 'done' END AS state,
  TIMESTAMP '2025-12-01 00:00:00' + INTERVAL 1 DAY * (5 * (f.file_key % 5)) + INTERVAL 1 SECOND * f.file_key AS acted_utc, last_mount_point, attached FROM files f JOIN volumes USING (volume_id)),
paths AS (SELECT lower(destination) AS p, size + (CASE WHEN action_id % 12 = 0 THEN 1 ELSE 0 END) AS actual FROM acts WHERE action_id % 6 <> 1
  UNION ALL SELECT lower(last_mount_point || origin_rel), size FROM acts WHERE action_id % 9 = 4 AND last_mount_point IS NOT NULL)
"""


def _acts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    files, vols = _fv(spark, sf)
    k = F.col("file_key")
    rows = files.join(F.broadcast(vols), "volume_id").select(
        k.alias("action_id"),
        F.concat(F.lit("b"), (k % 5).cast("string")).alias("batch_id"),
        "file_key",
        F.col("volume_guid").alias("origin_volume"),
        F.col("rel_path").alias("origin_rel"),
        F.concat(F.when(k % 23 == 0, "C:\\Elsewhere\\").otherwise("C:\\Quarantine\\"), "rel_path").alias("destination"),
        "size",
        F.when(k % 4 == 3, "undone").otherwise("done").alias("state"),
        (F.lit("2025-12-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval((5 * (k % 5)).cast("int"), F.lit(0), F.lit(0), k.cast("decimal(18,6)"))).alias("acted_utc"),
        "last_mount_point",
    )
    there = rows.where("action_id % 6 <> 1").select(F.col("destination").alias("path"), (F.col("size") + F.when(F.col("action_id") % 12 == 0, 1).otherwise(0)).alias("size"))
    taken = rows.where("action_id % 9 = 4 and last_mount_point is not null").select(F.concat("last_mount_point", "origin_rel").alias("path"), "size")
    return rows.drop("last_mount_point"), vols, there.unionByName(taken)


@query(
    "undo_dry_run",
    with_files(
        f""", {_ACTIONS} SELECT action_id, file_key, CASE WHEN NOT attached OR last_mount_point IS NULL THEN 'volume not attached' WHEN NOT EXISTS (SELECT 1 FROM paths WHERE p = lower(destination)) THEN 'quarantined file is gone'
        WHEN EXISTS (SELECT 1 FROM paths WHERE p = lower(last_mount_point || origin_rel)) THEN 'original path is occupied' ELSE 'would restore' END AS outcome FROM acts WHERE batch_id = 'b1' AND state = 'done'"""
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    acts, vols, paths = _acts(spark, sf)
    return actions.undo_dry_run(acts, vols, paths, "b1")


@query(
    "purge_dry_run",
    with_files(
        f""", {_ACTIONS}, d AS (SELECT acts.*, (SELECT min(actual) FROM paths WHERE p = lower(destination)) AS actual FROM acts WHERE batch_id = 'b2' AND state = 'done'),
        o AS (SELECT *, CASE WHEN NOT starts_with(lower(destination), 'c:\\quarantine\\') THEN 'refused: not inside' WHEN actual IS NULL THEN 'skipped: gone' WHEN actual <> size THEN 'refused: size changed' ELSE 'would delete' END AS outcome FROM d)
        SELECT action_id, outcome, CASE WHEN outcome = 'would delete' THEN actual ELSE 0 END AS bytes_freed FROM o"""
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    acts, _, paths = _acts(spark, sf)
    return actions.purge_dry_run(acts, paths.groupBy("path").agg(F.min("size").alias("size")), "b2", "C:\\Quarantine", _NOW)


@query(
    "batch_history",
    with_files(
        f""", {_ACTIONS}, h AS (SELECT batch_id, count(*) AS files, sum(size)::BIGINT AS bytes, min(acted_utc) AS started, count(*) FILTER (NOT EXISTS (SELECT 1 FROM paths WHERE p = lower(destination))) AS missing FROM acts WHERE state = 'done' GROUP BY batch_id)
        SELECT batch_id, files, bytes, missing, (epoch_us(TIMESTAMP '2026-01-01') - epoch_us(started)) // 3600000000 AS age_hours, CASE WHEN (epoch_us(TIMESTAMP '2026-01-01') - epoch_us(started)) // 3600000000 >= 336 THEN 'ripe' ELSE 'kept' END AS status FROM h"""
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    acts, _, paths = _acts(spark, sf)
    return actions.history(acts, paths, _NOW).select("batch_id", "files", "bytes", "missing", "age_hours", "status")


@query(
    "hardlink_eligibility",
    with_files(
        f""", {_PLAN}, f AS (SELECT file_key, volume_id, file_id_low, present FROM files) SELECT q.file_key, q.kept_file_key, CASE WHEN q.volume_id <> k.volume_id THEN 'different volumes' WHEN NOT k.present THEN 'keeper missing'
        WHEN k.file_id_low IS NULL THEN 'no file ids' WHEN k.file_id_low = q.file_id_low THEN 'already the same file' WHEN q.file_system <> 'NTFS' THEN 'file system has no hardlinks' ELSE 'eligible' END AS outcome
        FROM plan q JOIN f k ON k.file_key = q.kept_file_key WHERE action = 'Quarantine'"""
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return actions.hardlink_eligibility(_plan(spark, sf), *_fv(spark, sf))


@query(
    "merge_candidates",
    with_files(
        f""", {_PLAN}, k AS (SELECT group_key, file_key AS keeper FROM plan WHERE action = 'Keep' AND date_taken IS NULL AND ends_with(lower(rel_path), '.jpg')),
        d AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY exif_tags DESC, file_key) AS r FROM plan WHERE action = 'Quarantine' AND date_taken IS NOT NULL AND exif_tags > 0)
        SELECT group_key, keeper, d.file_key AS donor, d.date_taken AS donor_date, d.exif_tags AS donor_tags FROM k JOIN d USING (group_key) WHERE r = 1"""
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return actions.merge_candidates(_plan(spark, sf))


@query(
    "review_queue",
    with_files(
        f""", {_PLAN} SELECT group_key, count(DISTINCT pixel_hash) AS pictures, bool_or(coalesce(exif_tags > ktags, false) OR (date_taken IS NOT NULL AND kdate IS NULL)) AS conflict,
        coalesce(sum(size) FILTER (action = 'Quarantine'), 0)::BIGINT AS reclaimable, count(*) AS files, CASE WHEN count(DISTINCT pixel_hash) = 1 THEN 'accepted' ELSE 'review' END AS queue FROM plan GROUP BY group_key"""
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return actions.review_queue(_plan(spark, sf))


@query(
    "review_ordinals",
    with_files(f""", {_PLAN} SELECT group_key, file_key, row_number() OVER (PARTITION BY group_key ORDER BY (action = 'Keep') DESC, img_width::BIGINT * img_height DESC, file_key)::INT AS ordinal FROM plan"""),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return actions.ordinals(_plan(spark, sf))


@query(
    "review_best_cells",
    with_files(
        f""", {_PLAN}, v AS (SELECT group_key, file_key, img_width::BIGINT * img_height AS p, exif_tags AS t, coalesce(jpeg_quality, 0) AS q FROM plan)
        SELECT group_key, file_key, p = max(p) OVER w AND min(p) OVER w < max(p) OVER w AS best_pixels, t = max(t) OVER w AND min(t) OVER w < max(t) OVER w AS best_tags, q = max(q) OVER w AND min(q) OVER w < max(q) OVER w AS best_quality
        FROM v WINDOW w AS (PARTITION BY group_key)"""
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return actions.best_cells(_plan(spark, sf))


@query(
    "review_restore",
    with_files(
        """, g AS (SELECT pixel_hash AS cluster_key, list(file_key) AS members FROM files GROUP BY pixel_hash HAVING count(*) > 1),
        d AS (SELECT pixel_hash AS cluster_key, file_key AS k, CASE WHEN file_key % 2 = 0 THEN 'confirmed' ELSE 'skipped' END AS state, file_key % 97 AS decided FROM files WHERE file_key % 3 <> 0 UNION ALL SELECT pixel_hash, file_key + 1, 'confirmed', 200 FROM files WHERE file_key % 11 = 0),
        last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_key ORDER BY decided DESC, k DESC) AS r FROM d) WHERE r = 1)
        SELECT g.cluster_key, len(members)::INT AS n_members, CASE WHEN list_contains(members, k) THEN k END AS keeper_file_key, CASE WHEN list_contains(members, k) THEN state ELSE 'open' END AS state FROM g LEFT JOIN last USING (cluster_key)"""
    ),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    files = catalog.files(spark, sf).select(F.col("pixel_hash").alias("cluster_key"), "file_key")
    groups = files.groupBy("cluster_key").agg(F.collect_list("file_key").alias("members")).where(F.size("members") > 1)
    k = F.col("file_key")
    one = files.where("file_key % 3 <> 0").select("cluster_key", k.alias("keeper_file_key"), F.when(k % 2 == 0, "confirmed").otherwise("skipped").alias("state"), (k % 97).alias("decided_utc"))
    two = files.where("file_key % 11 = 0").select("cluster_key", (k + 1).alias("keeper_file_key"), F.lit("confirmed").alias("state"), F.lit(200).cast("bigint").alias("decided_utc"))
    return actions.review_restore(groups, one.unionByName(two))


@query(
    "current_action_state",
    """WITH log AS (SELECT event_id % 500 AS action_id, event_id AS seq, event_type AS state FROM events) SELECT action_id, max(seq) AS seq, arg_max(state, seq) AS state FROM log GROUP BY action_id""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    log = spark.read.parquet(f"{sf}/events.parquet").select((F.col("event_id") % 500).alias("action_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("state"))
    return actions.current_state(log)


@query(
    "burst_sessions",
    """WITH e AS (SELECT user_id, ts, value, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e)
    SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 5 MINUTE AS ended, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, run""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.bursts(spark.read.parquet(f"{sf}/events.parquet")).withColumn("total", F.round("total", 4))


@query("band_layout", "SELECT * FROM (VALUES (0, 0, 13), (1, 13, 13), (2, 26, 13), (3, 39, 13), (4, 52, 12)) t(band, first_bit, width)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    layout = bits.band_layout(4)
    return spark.range(len(layout)).select(F.col("id").cast("int").alias("band"), *[F.element_at(F.array(*[F.lit(x[k]) for x in layout]), F.col("id").cast("int") + 1).alias(n) for k, n in ((0, "first_bit"), (1, "width"))])
