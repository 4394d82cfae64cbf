"""Pairs by bands: each once, judged where buckets meet."""

import functools
import itertools
import operator
import random
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinsight.functions import images
from kinsight.functions.bits import band_layout
from kinsight.operators import banded, similar

SCHEMA = "file_key bigint, dhash bigint, phash bigint, thumb16 array<smallint>, thumb_mean double, contrast double, date_taken bigint, sub_sec int, name string, pixel_hash string"


def prints(n, seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) - (1 << 63) for _ in range(4)]
    made = []
    for k in range(n):
        d, p = rng.choice(base), rng.getrandbits(64) - (1 << 63)
        for _ in range(rng.randrange(7)):
            d ^= 1 << rng.randrange(62)
        thumb = [rng.randrange(99) for _ in range(3 if k % 17 == 0 else 4)]
        hashes = (None if k % 11 == 0 else d, None if k % 13 == 0 else base[0] if k % 7 == 0 else p)
        name = rng.choice(("IMG_01.jpg", "img_02.jpg", "a03.jpg", "wedding.jpg"))
        made.append((k, *hashes, thumb, sum(thumb) / len(thumb), float(rng.randrange(4, 30)), rng.choice((None, 1, 2)), rng.choice((None, 5, 6)), name, f"p{k}"))
    return made


def apart(a, b):
    if a[6] is not None and b[6] is not None:
        return a[6] != b[6] or (a[7] is not None and b[7] is not None and a[7] != b[7])
    s = {"IMG_01.jpg": ("img_", 1), "img_02.jpg": ("img_", 2), "a03.jpg": ("a", 3)}
    return a[8] in s and b[8] in s and s[a[8]][0] == s[b[8]][0] and s[a[8]] != s[b[8]]


def shared(a, b):
    """The bands that two rows share."""
    for h in (1, 2):
        if a[h] is not None and b[h] is not None:
            for k, (offset, width) in enumerate(band_layout(4)):
                if not ((a[h] ^ b[h]) >> offset) & ((1 << width) - 1):
                    yield h, k, a[h] >> offset & ((1 << width) - 1)


@pytest.mark.parametrize("tile,most", [(1 << 14, None), (10, None), (10, 30)])
def test_pairs_by_brute_force(spark, monkeypatch, tile, most):
    """Tiles, null hashes and left-out buckets; every pair once, without a shuffle of pairs."""
    monkeypatch.setattr(banded, "TILE", tile)
    rows = prints(160, tile)
    df, options = spark.createDataFrame(rows, SCHEMA), similar.Similarity(max_bucket=most)
    count = {}
    for r in rows:
        for b in shared(r, r):
            count[b] = count.get(b, 0) + 1
    meet = [(a, b) for a, b in itertools.combinations(rows, 2) if any(most is None or count[s] <= most for s in shared(a, b))]
    found = similar.candidate_pairs(df, options)
    assert sorted(map(tuple, found.collect())) == sorted((a[0], b[0]) for a, b in meet)
    want = {}
    for a, b in meet:
        bits = min(((a[h] ^ b[h]) & (1 << 64) - 1).bit_count() for h in (1, 2) if a[h] is not None and b[h] is not None)
        if bits <= 4 and min(a[5], b[5]) >= 6:
            gain = a[5] / b[5]
            thumb = None if len(a[3]) != len(b[3]) else functools.reduce(operator.add, (abs(x - ((y - b[4]) * gain + a[4])) for x, y in zip(a[3], b[3], strict=True))) / len(a[3])
            want[a[0], b[0]] = bits, thumb, apart(a, b)
    near = similar.near_pairs(df, options)
    got = near.collect()
    assert len(got) == len(want) and {(r.i, r.j): (r.hamming, r.thumbnail, r.separate) for r in got} == want
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.split("MapInArrow")[0] and "Exchange" not in plan.split("MapInArrow")[0]


def test_wide_and_narrow_rows_find_the_same(monkeypatch):
    rng = np.random.default_rng(3)
    d, p = rng.integers(0, 64, (2, 300)).astype(np.uint64)
    ends = np.repeat([200, 210, 300], [200, 10, 90])
    low = np.arange(300) + 1
    want = {(a, b) for a in range(300) for b in range(a + 1, ends[a]) if min((int(d[a]) ^ int(d[b])).bit_count(), (int(p[a]) ^ int(p[b])).bit_count()) <= 1}
    for wide, some in ((1000, 50), (0, 50), (20, 1000)):
        monkeypatch.setattr(banded, "WIDE", wide)
        monkeypatch.setattr(banded, "PAIRS", some)
        got = [(int(x), int(y)) for a, b in banded.close(d, p, low, ends, 1) for x, y in zip(a, b, strict=True)]
        assert len(got) == len(want) and set(got) == want


def test_a_thumbnail_on_the_edge_of_a_cell(spark):
    """Its distance is 16.0 in SQL; by deviations of other last bits it was 15.999999999999998, a cell lower."""
    a = [73, 9, 68, 26, 85, 0, 9, 0, 75, 2, 0, 7, 14, 60, 63, 0, 19, 31, 48, 14, 34, 0, 0, 0, 0, 7]
    b = [54, 4, 0, 25, 98, 0, 6, 91, 41, 0, 0, 6, 0, 96, 52, 0, 0, 41, 43, 98, 20, 0, 9, 0, 2, 0]
    rows = [(1, 5, 5, a, sum(a) / 26, 0.0, None, None, "a.jpg", "A"), (2, 5, 5, b, sum(b) / 26, 0.0, None, None, "b.jpg", "B")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("contrast", images.spread(F.col("thumb16")))
    assert [r.contrast for r in df.orderBy("file_key").collect()] == [duckdb.connect().execute(f"select list_stddev_pop({t}::smallint[])").fetchone()[0] for t in (a, b)]
    cells = similar.histogram(similar.near_pairs(df), "thumbnail", 64).where("n > 0").collect()
    assert [(r.cell, r.n) for r in cells] == [(16, 1)]


def test_facts_take_little_memory():
    """Before, the cells of a group and their places were made as eight-byte numbers at once: 13 MB here, without what Arrow held."""
    n = 20_000
    cells = np.arange(26 * n).astype(np.int16) % 900
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 26), pa.array(cells))
    none = pa.nulls(n, pa.int64())
    columns = {"file_key": pa.array(np.arange(n)), "dhash": none, "phash": none, "shut": none, "kind": none, "band": none}
    columns |= {"thumb16": lists, "thumb_mean": none, "contrast": none, "date_taken": none, "sub_sec": none, "prefix": pa.nulls(n, pa.string()), "number": pa.nulls(n, pa.string())}
    rows = banded.Rows(pa.table(columns), 4)
    tracemalloc.start()
    facts = banded.Facts(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (facts.thumbs.T == cells.reshape(n, 26)).all() and peak < 8 << 20
