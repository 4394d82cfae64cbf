"""File names, paths and hashes."""

import pytest
from pyspark.sql import functions as F

from kinsight.functions import bits, names

NOW = "2026-01-01 00:00:00"


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_series_guard(spark):
    cases = [
        ("_MG_8676.jpg", "_MG_8677.jpg", True),
        ("NTN_5177.jpg", "NTN_5178.jpg", True),
        ("20140622_144445.jpg", "20140622_144446.jpg", True),
        ("a_100.jpg", "a_100.jpg", False),
        ("_MG_8676.jpg", "_MG_8676 (1).jpg", False),
        ("_MG_8676.jpg", "_MG_8676 - Copy.jpg", False),
        ("IMG_0452.CR2", "IMG_0452.jpg", False),
        ("holiday.jpg", "wedding.jpg", False),
        ("1.jpg", "2.jpg", False),
    ]
    df = rows(spark, cases, "a string, b string, want boolean")
    got = df.select("a", "b", "want", names.different_frames(names.series(F.col("a")), names.series(F.col("b"))).alias("got")).collect()
    assert [(r.a, r.b, r.got) for r in got] == cases


def test_filename_dates(spark):
    taken = "2021-05-01 17:23:47"
    cases = [
        ("IMG_20210501_172347.jpg", taken, "Camera"),
        ("PXL_20210501_172347123.jpg", taken, "Camera"),
        ("20210501_172347.jpg", taken, "Camera"),
        ("viber_image_2021-05-01_17-23-47.jpg", taken, "Messaging"),
        ("photo_2021-05-01_17-23-47.jpg", taken, "Messaging"),
        ("signal-2021-05-01-172347.jpg", taken, "Messaging"),
        ("Screenshot_20210501-172347.png", taken, "Camera"),  # the plain date and time comes first in the order of patterns
        ("Screenshot 2021-05-01 172347.png", taken, "Screenshot"),
        ("IMG-20210501-WA0012.jpg", "2021-05-01 00:00:00", "Messaging"),
        ("FB_IMG_1619875427123.jpg", "2021-05-01 13:23:47", "Messaging"),
        ("DCIM\\100\\x.jpg", None, "Camera"),
        ("Zalo\\x.jpg", None, "Messaging"),
        ("a\\Downloads\\x.jpg", None, "Download"),
        ("a\\Screenshots\\x.jpg", None, "Screenshot"),
        ("wedding.jpg", None, "Unknown"),
        ("IMG_99999999_999999.jpg", None, "Unknown"),
        ("18000101_000000.jpg", None, "Unknown"),
        ("IMG_20990101_000000.jpg", None, "Unknown"),
    ]
    df = rows(spark, cases, "path string, taken string, source string")
    got = df.select("path", names.filename_facts(F.col("path"), NOW).alias("f")).select("path", F.date_format("f.taken", "yyyy-MM-dd HH:mm:ss").alias("t"), "f.source").collect()
    assert [tuple(r) for r in got] == cases


def test_tiers_and_folders(spark):
    df = rows(spark, [("a.nef",), ("b.CR2",), ("c.png",), ("d.heic",), ("e.xyz",), ("f",)], "name string")
    assert [r.t for r in df.select(names.tier(F.col("name")).alias("t")).collect()] == [3, 3, 2, 1, 0, 0]
    df = rows(spark, [("x.jpg",), ("a\\x.jpg",), ("a\\b\\c\\d\\x.jpg",)], "p string")
    assert [r.f for r in df.select(names.folder_at(F.col("p"), 3).alias("f")).collect()] == ["(volume root)", "a", "a\\b\\c"]


def test_containment(spark):
    cases = [
        ("C:\\Quarantine\\batch\\a.jpg", True),
        ("C:\\Quarantine", False),
        ("C:\\Quarantine-old\\a.jpg", False),
        ("C:\\Photos\\a.jpg", False),
        ("C:\\Quarantine\\..\\Photos\\a.jpg", False),
    ]
    df = rows(spark, cases, "p string, want boolean")
    assert [r.g for r in df.select(names.is_inside(F.col("p"), F.lit("C:\\Quarantine")).alias("g")).collect()] == [w for _, w in cases]


def test_camera(spark):
    cases = [("NIKON CORPORATION", "NIKON D750", "NIKON D750"), ("Canon", "Canon EOS", "Canon EOS"), ("Sony", "A7", "Sony A7"), (None, "X", "X"), ("Y", None, "Y"), (None, None, None)]
    df = rows(spark, cases, "make string, model string, want string")
    assert [r.g for r in df.select(names.camera(F.col("make"), F.col("model")).alias("g")).collect()] == [c[2] for c in cases]


@pytest.mark.parametrize("text,size", [("64KB", 65536), ("1.5 G", 1610612736), ("300", 300), ("2M", 2097152)])
def test_sizes(text, size):
    assert names.parse_size(text) == size


def test_durations():
    assert [names.parse_duration(x) for x in ("14d", "36h", "30m")] == [1209600, 129600, 1800]


def test_bands(spark):
    assert [w for _, w in bits.band_layout(4)] == [13, 13, 13, 13, 12]
    assert sum(w for _, w in bits.band_layout(6)) == 64
    df = rows(spark, [(0, -1), (5, 6)], "a bigint, b bigint")
    assert [r.h for r in df.select(bits.hamming(F.col("a"), F.col("b")).alias("h")).collect()] == [64, 2]


def test_containment_resolves_any_depth(spark):
    """Ten folders and eleven steps up end outside; a drive has nothing above it."""
    cases = [
        ("C:\\Quarantine" + "\\a" * 10 + "\\.." * 11 + "\\x.jpg", False),
        ("C:\\Quarantine" + "\\a" * 10 + "\\.." * 10 + "\\x.jpg", True),
        ("C:\\..\\..\\Quarantine\\x.jpg", True),
        ("C:\\Quarantine\\.\\x.jpg", True),
        ("C:/quarantine/b/../x.jpg", True),
        ("C:\\Quarantine", False),
    ]
    rows = spark.createDataFrame(cases, "path string, inside boolean")
    for r in rows.select("path", "inside", names.is_inside(F.col("path"), F.lit("C:\\Quarantine")).alias("got")).collect():
        assert r.got == r.inside, r.path
