"""Registration: names, oracles, and the flagship query."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_all_required_queries_are_registered():
    names = [n.split("_")[0] for n in entry.queries()]
    assert all(names.count(f"op{k}") == 1 for k in range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("name", ["exact_duplicate_groups", "cascade_cost", "folder_report", "scope_filter", "plan_rows", "undo_dry_run"])
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    text = lambda r: tuple(f"{v:.9f}" if isinstance(v, float) else str(v) for v in r)
    assert sorted(map(text, df.select(*columns).collect())) == sorted(map(text, want.fetchall()))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
