"""Write-backs, logs and clusters of copies."""

from pyspark.sql import functions as F

from kinsight.operators import similar, state
from kinsight.operators.components import components


def test_components_of_awkward_edges(spark):
    chain = [(i, i + 1) for i in range(100)]
    edges = spark.createDataFrame([*chain, *chain, (5, 5), (None, 3), (900, 901), (902, 901)], "u bigint, v bigint").repartition(5)
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(101)}, 900: 900, 901: 900, 902: 900}
    assert components(edges.limit(0)).count() == 0


def test_equal_prints_make_links_in_proportion(spark):
    """Files that nothing tells apart hang on one of them; those of another moment are no copies."""
    n = 3000
    rows = spark.range(n).select(
        F.col("id").alias("file_key"), F.lit(5).cast("bigint").alias("dhash"), F.lit(9).cast("bigint").alias("phash"), F.array(*[F.lit(k).cast("smallint") for k in (1, 90)]).alias("thumb16"),
        F.lit(40.0).alias("contrast"), F.lit(45.5).alias("thumb_mean"), (F.col("id") % 2).alias("date_taken"), F.lit(None).cast("int").alias("sub_sec"), F.lit("a.jpg").alias("name"),
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("pixel_hash"),
    )
    heads = similar.alike(rows)
    assert heads.count() == n and {r.head for r in heads.select("head").distinct().collect()} == {0, 1}
    got = similar.clusters(rows).groupBy("cluster").count().collect()
    assert sorted((r.cluster, r["count"]) for r in got) == [(0, n // 2), (1, n // 2)]


def test_write_backs_are_idempotent(spark):
    files = spark.createDataFrame([(1, "p", "c", 5, 6), (2, None, None, None, None)], "file_key bigint, partial_hash string, content_hash string, hashed_size bigint, hashed_mtime bigint")
    probed = spark.createDataFrame([(1, "q", None, 7, 8), (1, "q", None, 7, 8), (9, "z", "z", 1, 1)], "file_key bigint, partial_hash string, content_hash string, size bigint, mtime bigint")
    once = state.write_probes(files, probed)
    assert sorted(map(tuple, once.collect())) == [(1, "q", "c", 7, 8), (2, None, None, None, None)]
    assert sorted(map(tuple, state.write_probes(once, probed).collect())) == sorted(map(tuple, once.collect()))


def test_a_catalog_in_use_is_not_reset(spark):
    log = spark.createDataFrame([("b", "undone"), ("b", "purged")], "batch_id string, state string")
    assert state.reset_verdict(log).first().verdict == "may be reset"
    assert state.reset_verdict(log.limit(0)).first().files == 0
    assert state.reset_verdict(log.unionByName(spark.createDataFrame([("c", "done")], log.schema))).first().verdict.startswith("refused")


def test_moves_follow_the_states(spark):
    log = spark.createDataFrame([(1, 1, "planned"), (1, 2, "done"), (2, 1, "planned")], "action_id bigint, seq bigint, state string")
    wanted = spark.createDataFrame([(1, "undone"), (2, "undone"), (2, "failed"), (3, "done")], "action_id bigint, state string")
    got = sorted((r.action_id, r.state, r.verdict) for r in state.checked_moves(log, wanted).collect())
    assert got == [(1, "undone", "moved"), (2, "failed", "moved"), (2, "undone", "refused"), (3, "done", "unknown action")]


def test_where_the_catalog_is():
    assert state.catalog_folder("new", "old", {"old"}.__contains__) == "old"
    assert state.catalog_folder("new", "old", {"old", "new"}.__contains__) == "new"
    assert state.catalog_folder("new", "old", set().__contains__) == "new"
