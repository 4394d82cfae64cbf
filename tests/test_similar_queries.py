"""The queries on near duplicates: the rows of their SQL, and no shuffle that is dealt by pairs."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from kinsight.operators import similar

SF = "/root/testdata/sf0.001"
NAMES = [
    "band_candidates",
    "cluster_metrics",
    "pixel_groups",
    "similar_largest",
    "similar_summary",
    "calibration",
    "clusters",
    "review_totals",
    "similar_listing",
    "similarity_totals",
    "cluster_key",
    "hamming_histogram",
    "similar_identical",
    "similar_pairs",
    "thumbnail_histogram",
]


@pytest.mark.parametrize("name", NAMES)
def test_no_pairs_are_shuffled(spark, monkeypatch, name):
    made = []
    for f in ("near_pairs", "candidate_pairs"):
        monkeypatch.setattr(similar, f, lambda *a, f=getattr(similar, f): made.append(f(*a)) or made[-1])
    df = entry.queries()[name](spark, SF)
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in made]
    assert plans and not any(re.search(r"hashpartitioning\([ij]#", p) for p in plans)
    con = duckdb.connect()
    for t in ("documents", "labels", "events"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    text = lambda r: tuple(f"{v:.9f}" if isinstance(v, float) else str(v) for v in r)
    assert sorted(map(text, df.select(*columns).collect())) == sorted(map(text, want.fetchall()))
