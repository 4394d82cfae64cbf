"""Incremental ingestion resumes and keeps the last event of each file."""

from kinsight.streaming import ingest

SCHEMA = "volume_id int, rel_path string, seq bigint, size bigint, mtime bigint"


def test_ingest_and_resume(spark, tmp_path):
    source, catalog, state = (f"file://{tmp_path}/{n}" for n in ("in", "catalog", "state"))
    first = [(1, "a", 1, 10, 1), (1, "b", 2, 20, 1), (1, "a", 3, 11, 2)]
    spark.createDataFrame(first, SCHEMA).coalesce(1).write.parquet(source)
    for more in ([], [(1, "b", 9, 25, 3), (2, "c", 10, 1, 1)]):
        if more:
            spark.createDataFrame(more, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        ingest.ingest(ingest.crawl_stream(spark, source, SCHEMA), catalog, state).awaitTermination(60)
    got = {(r.volume_id, r.rel_path): r["size"] for r in ingest.read_catalog(spark, catalog).collect()}
    assert got == {(1, "a"): 11, (1, "b"): 25, (2, "c"): 1}
    known = ingest.read_catalog(spark, catalog)
    events = spark.createDataFrame([(1, "a", 20, 11, 2), (1, "b", 21, 99, 4)], SCHEMA)
    assert [r.rel_path for r in ingest.changed(events, known).collect()] == ["b"]


def test_unchanged_files_of_a_new_crawl_are_not_written_again(spark, tmp_path):
    source, catalog, state = (f"file://{tmp_path}/{n}" for n in ("in", "catalog", "state"))
    for events in ([(1, "a", 1, 10, 1), (1, "b", 2, 20, 1)], [(1, "a", 3, 10, 1), (1, "b", 4, 21, 2)]):
        spark.createDataFrame(events, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        ingest.ingest(ingest.crawl_stream(spark, source, SCHEMA), catalog, state).awaitTermination(60)
    log = [(r.rel_path, r["size"]) for r in spark.read.parquet(catalog).collect()]
    assert sorted(log) == [("a", 10), ("b", 20), ("b", 21)]
