"""Scopes, duplicates, similarity, keeper and plans on small tables."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from kinsight.operators import actions, exact, keeper, scope, similar
from kinsight.operators.components import components
from kinsight.sources import plan_csv


@pytest.fixture(scope="module")
def small(spark):
    volumes = spark.createDataFrame([(1, "{vol-e}", "E:\\", True), (2, "{vol-f}", "F:\\", True)], "volume_id int, volume_guid string, last_mount_point string, attached boolean")
    paths = [(10, 1, "Photos\\wedding\\a.jpg"), (11, 1, "Photos\\trip\\b.jpg"), (12, 1, "_mvc\\assets\\logo.png"), (20, 2, "Photos\\wedding\\c.jpg"), (21, 2, "Video\\clip.mp4")]
    return spark.createDataFrame(paths, "file_key bigint, volume_id int, rel_path string"), volumes


@pytest.mark.parametrize(
    "under,exclude,keys",
    [
        ((), (), [10, 11, 12, 20, 21]),
        (("F:\\",), (), [20, 21]),
        (("F:\\Photos",), (), [20]),
        (("Photos",), (), [10, 11, 20]),
        (("E:\\Photos\\trip", "F:\\Video"), (), [11, 21]),
        (("E:\\",), ("_mvc",), [10, 11]),
        (("Z:\\",), (), []),
    ],
)
def test_scopes(small, under, exclude, keys):
    files, volumes = small
    assert sorted(r.file_key for r in scope.in_scope(files, volumes, scope.Scope(under, exclude)).collect()) == keys


def test_crawl_filter(spark):
    names = [("photo.jpg", True), ("photo.JPG", True), ("photo.nef", True), ("notes.txt", False), ("noextension", False), ("trailingdot.", False)]
    df = spark.createDataFrame([(f"x\\{n}", n, 99999, 32, t) for n, t in names], "rel_path string, name string, size bigint, attributes bigint, want boolean")
    assert [(r.name, r.ok) for r in df.select("name", scope.refusal(scope.Crawl()).isNull().alias("ok")).collect()] == names


def test_components_by_brute_force(spark):
    rng = random.Random(4)
    for n, m in ((30, 25), (60, 40), (12, 0)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(100 + i, 101 + i) for i in range(40)]
        up = {x: x for e in edges for x in e}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
        alone = {x for x in up if all(a == b for a, b in edges if x in (a, b))}
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
        assert got == {x: root(x) for x in up if x not in alone}


def test_banded_join_equals_all_pairs(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(60) for _ in range(12)]
    rows = []
    for k in range(120):
        d = rng.choice(base)
        for _ in range(rng.randrange(7)):
            d ^= 1 << rng.randrange(60)
        rows.append((k, d, rng.getrandbits(60)))
    options = similar.Similarity(max_bucket=None)
    pairs = similar.candidate_pairs(spark.createDataFrame(rows, "file_key bigint, dhash bigint, phash bigint"), options)
    got = {(r.i, r.j) for r in pairs.collect()}
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if min((a[1] ^ b[1]).bit_count(), (a[2] ^ b[2]).bit_count()) <= 4}
    assert want <= got


def test_exact_groups_count_hardlinks_once(spark):
    rows = [(1, 1, "a", 5), (2, 1, "b", 5), (3, 1, "c", None), (4, 1, "d", None), (5, 1, "e", 9)]
    files = spark.createDataFrame([(k, v, p, i, 100, "p", "h", True) for k, v, p, i in rows], "file_key bigint, volume_id int, rel_path string, file_id_low bigint, size bigint, partial_hash string, content_hash string, present boolean")
    volumes = spark.createDataFrame([(1, True)], "volume_id int, attached boolean")
    r = exact.groups(files, volumes).first()
    assert (r.entries, r.copies, r.hardlinked, r.reclaimable) == (5, 4, 1, 300)


COLUMNS = "file_key bigint, g string, rel_path string, name string, size bigint, mtime bigint, img_width int, img_height int, date_taken bigint, has_exif boolean, exif_tags int, jpeg_quality int"


def candidates(spark, *rows):
    base = {"g": "g", "size": 5000000, "mtime": 0, "img_width": 4000, "img_height": 3000, "date_taken": None, "has_exif": False, "exif_tags": 0, "jpeg_quality": None}
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    made = []
    for k, r in enumerate(rows, 1):
        full = base | {"file_key": k} | r
        full["name"] = full["rel_path"].rsplit("\\")[-1]
        made.append(tuple(full[n] for n in names))
    return keeper.scored(spark.createDataFrame(made, COLUMNS), keeper.Policy(preferred=("Photos",)))


@pytest.mark.parametrize("rank", [keeper.rank_by_band, keeper.rank_pairwise])
def test_keeper(spark, rank):
    def first(*rows):
        return rank(candidates(spark, *rows), "g").where("rank = 1").first().file_key

    assert first({"rel_path": "a.jpg", "img_width": 1000, "img_height": 750}, {"rel_path": "b.jpg"}) == 2
    assert first({"rel_path": "a.jpg"}, {"rel_path": "b.jpg", "date_taken": 1}) == 2
    assert first({"rel_path": "Photos\\a.jpg"}, {"rel_path": "OldBackup\\IMG_9999.jpg", "date_taken": 1, "exif_tags": 48, "has_exif": True}) == 2
    assert first({"rel_path": "a.jpg"}, {"rel_path": "a.nef"}) == 2
    assert first({"rel_path": "a.jpg", "jpeg_quality": 70}, {"rel_path": "b.jpg", "jpeg_quality": 92}) == 2
    assert first({"rel_path": "b.jpg"}, {"rel_path": "a.jpg"}) == 2


def test_reasons_leave_camera_names_alone(spark):
    got = candidates(spark, {"rel_path": "OldBackup\\IMG_9999.jpg"}, {"rel_path": "x - Copy.jpg"}).orderBy("file_key").collect()
    assert "copy" not in got[0].reasons and "looks like a copy" in got[1].reasons


def plan_row(**kw):
    base = dict.fromkeys(plan_csv.COLUMNS) | {"group": 1, "kind": "ExactBytes", "action": "Keep", "file_key": 7, "score": 3, "width": 10, "height": 20, "size": 99, "has_exif": 1, "exif_tags": 4}
    return tuple((base | kw)[c] for c in plan_csv.COLUMNS)


def test_plan_csv_round_trip(spark, tmp_path):
    kinds = {c: "bigint" for c in ("group", "file_key", "kept_file_key", "score", "width", "height", "size", "has_exif", "exif_tags", "jpeg_quality")}
    schema = ", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in plan_csv.COLUMNS)
    rows = [plan_row(path='a, "b"\\c.jpg', pixel_hash="AB", volume_guid="{v}", volume="E:\\", reason="x; y"), plan_row(action="Quarantine", kept_file_key=7, file_key=8, path="d.jpg", volume_guid="", volume="", reason="")]
    plan_csv.write_plan(spark.createDataFrame(rows, schema), f"file://{tmp_path}/plan")
    got = plan_csv.read_plan(spark, f"file://{tmp_path}/plan").orderBy("file_key").collect()
    parts = [f.read_bytes() for f in (tmp_path / "plan").glob("*.csv")]
    assert parts and all(p.startswith(b"\xef\xbb\xbfgroup,") for p in parts)
    assert [(r.file_key, r.action, r.path, r.kept_file_key, r.size) for r in got] == [(7, "Keep", 'a, "b"\\c.jpg', None, 99), (8, "Quarantine", "d.jpg", 7, 99)]
    assert got[0].pixel_hash == "AB"


def test_plan_csv_drops_what_it_cannot_tell(spark, tmp_path):
    lines = [",".join(plan_csv.COLUMNS), "1,ExactBytes,keep,1,,x,1,1,5,1,2,,,g,v,p,h,r", "1,ExactBytes,burn,2,1,1,1,1,5,1,2,,,g,v,p,h,r", "1,ExactBytes,Keep,3", ""]
    (tmp_path / "p.csv").write_text("\n".join(lines))
    got = plan_csv.read_plan(spark, f"file://{tmp_path}/p.csv").collect()
    assert [(r.file_key, r.action, r.score) for r in got] == [(1, "Keep", 0)]


def test_latest_decision_wins(spark):
    rows = [("c1", 1, "skipped", 1), ("c1", 2, "confirmed", 5), ("c2", 9, "confirmed", 3)]
    decisions = spark.createDataFrame(rows, "cluster_key string, keeper_file_key bigint, state string, decided_utc bigint")
    clusters = spark.createDataFrame([("c1", [1, 2]), ("c2", [3, 4]), ("c3", [5])], "cluster_key string, members array<bigint>")
    got = {r.cluster_key: (r.keeper_file_key, r.state) for r in actions.review_restore(clusters, decisions).collect()}
    assert got == {"c1": (2, "confirmed"), "c2": (None, "open"), "c3": (None, "open")}


def test_cluster_key_is_of_the_members(spark):
    key = lambda ks: similar.cluster_keys(spark.createDataFrame([(k, 1) for k in ks], "file_key bigint, cluster bigint")).first().cluster_key
    assert key([3, 1, 2]) == key([1, 2, 3]) and len({key([1, 2]), key([1, 2, 3]), key([1, 2, 4])}) == 3


def test_split_by_exposure(spark):
    rows = spark.createDataFrame(
        [(1, 100, None, "A"), (2, 100, None, "B"), (3, 200, 5, "C"), (4, None, None, "C"), (5, None, None, "D")], "file_key bigint, date_taken bigint, sub_sec int, pixel_hash string"
    )
    linked = spark.createDataFrame([(k, 1) for k in range(1, 6)], "file_key bigint, cluster bigint")
    got = {(r.file_key, r.cluster) for r in similar.split_by_exposure(linked, rows).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (4, 3)}
