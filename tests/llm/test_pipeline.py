"""The pipeline's stages, each on its own input."""

import fixtures
import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(4)
    item = fixtures.prose(rng, 20)
    base = fixtures.prose(rng, 120)
    passage = fixtures.prose(rng, 60)
    rows = [(1, base), (2, base), (3, base.replace("w1 ", "w2 ", 1)), (4, fixtures.prose(rng, 60) + " " + item), (5, fixtures.prose(rng, 90) + " " + passage), (6, passage + " " + fixtures.prose(rng, 90))]
    rows += [(7, "short"), (8, None), (9, fixtures.prose(rng, 80)), (9, fixtures.prose(rng, 80)), (None, fixtures.prose(rng, 70)), (10, "again and again " * 60)]
    docs = spark.createDataFrame([(k, t, "xx", "s", len(t or "")) for k, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    path = f"file://{tmp_path}"
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    stages, now = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{path}/documents.parquet")
    assert list(stages) == ["quality_rules", "jaccard_join", "substring_dedup", "decontamination", "best_fit_packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, path)
        seen[name] = now.collect()
        if name != "best_fit_packing":
            assert now.columns == docs.columns
    ids = lambda name: sorted(str(r.doc_id) for r in seen[name])
    assert ids("quality_rules") == sorted(["1", "2", "3", "4", "5", "6", "9", "9", "None"])
    assert ids("jaccard_join") == sorted(["1", "4", "5", "6", "9", "9", "None"])
    assert passage not in next(r.text for r in seen["substring_dedup"] if r.doc_id == 6)
    assert "4" not in ids("decontamination") and "5" in ids("decontamination")
    assert {str(r.doc_id) for r in seen["best_fit_packing"]} == set(ids("decontamination"))
    assert corpus_pipeline.run(spark, path).count() == len(seen["best_fit_packing"])


CLASHING = "row string, d bigint, h bigint, others int, kept int, m int, text_hash string, class_node int, gone_d int, b int, __d int, __h int, __x int"


def test_stages_with_clashing_columns_and_empty_tables(spark, tmp_path):
    rng = random.Random(5)
    base = fixtures.prose(rng, 120)
    more = ("r", 1, 2, 3, 4, 5, "t", 6, 7, 8, 9, 10, 11)
    rows = [(1, base, "en", *more), (1, base, None, *more), (2, base, "en", *more), (3, fixtures.prose(rng, 80), "xx", *(None,) * 13), (None, None, None, *(None,) * 13)]
    docs = spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, {CLASHING}")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    for now, left in ((docs, 2), (docs.limit(0), 0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, f"file://{tmp_path}")
            found = [tuple(r) for r in now.collect()]
            assert now.columns == docs.columns and set(found) <= set(rows)
        assert len(found) == left
        assert stage is not corpus_pipeline.packing and corpus_pipeline.packing(spark, now, "").count() == left
    assert not found
