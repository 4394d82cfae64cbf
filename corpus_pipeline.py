"""The corpus pipeline: quality rules, near duplicates, repeated passages, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet in the shared folder and read again as the next stage's docs. All
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsight.llm import best_fit, decontaminate, jaccard_join, quality_rules, substring_dedup
from kinsight.llm.common import stored, table


def rows_of(docs: DataFrame, **more: Column) -> DataFrame:
    """Whole rows as one column beside those that a stage works on, so that no name of theirs can clash."""
    return docs.select(F.struct("*").alias("row"), *[c.alias(k) for k, c in more.items()])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts have too few words and go. Very long texts are judged whole. Each row is judged for itself, so rows
    that repeat are kept or go alike; an empty table gives one; a column may have any name.
    """
    return quality_rules.judge_quality(rows_of(docs, text=F.col("text"), lang=F.col("lang")), keep=["row"]).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: that of the least doc_id (nulls last), then of the least hash of its text.

    Of rows that have its id and text, the one whose other columns come first as JSON stays. Texts without words are no
    duplicates; all rows of them stay. Texts are compared whole; an empty table gives one; a column may have any name.
    """
    found = jaccard_join.join_similar(docs).where("class_node is not null")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("text_hash").alias("h"))
    best = stored(found.groupBy("class_node").agg(F.min(order).alias("b")).select("b.d", "b.h"), "best")
    others = F.to_json(F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")])) if len(docs.columns) > 2 else F.lit("")
    rows = rows_of(docs, d=F.col("doc_id"), h=F.xxhash64("text"), others=others)
    one = F.min_by("row", "others").alias("row")
    named = rows.join(best.where("d is not null"), ["d", "h"], "left_semi").groupBy("d", "h").agg(one)
    nameless = rows.where("d is null").join(best.where("d is null").select("h"), "h", "left_semi").groupBy("h").agg(one)
    wordless = rows.where(~F.coalesce(F.col("row.text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return named.select("row.*").unionByName(nameless.select("row.*")).unionByName(wordless.select("row.*"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that a document of smaller doc_id has, too.

    Null texts stay null; rows without an id lose nothing; rows that repeat an id lose nothing to each other. Texts are searched
    whole; a text may become empty; an empty table gives one; a column may have any name.
    """
    cut = substring_dedup.remove_repeats(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark.

    Null and empty texts are clean. Texts are searched whole; rows of one id and text go or stay together; an empty table, or
    benchmark, drops nothing; a column may have any name.
    """
    found = decontaminate.find_overlaps(docs, table(spark, sf_dir, "benchmark")).where(decontaminate.contaminated())
    bad = found.select(F.col("doc_id").alias("bad_d"), F.col("text_hash").alias("bad_h")).distinct()
    rows = rows_of(docs, d=F.col("doc_id"), h=F.xxhash64("text"))
    return rows.join(bad, F.col("d").eqNullSafe(F.col("bad_d")) & (F.col("h") == F.col("bad_h")), "left_anti").select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of the packed sequences, with its token ids.

    A null or empty text is its end token alone; a very long one is cut into pieces; rows that repeat are packed each; an empty
    table gives no rows; other columns are not read.
    """
    return best_fit.pack(docs, best_fit.vocabulary_path())


STAGES = [
    ("quality_rules", quality),
    ("jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontamination", decontamination),
    ("best_fit_packing", packing),
]

#: SQL can't express the tokenizer of the last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
