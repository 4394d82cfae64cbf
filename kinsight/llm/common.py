"""Helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsight.storage import scratch, stored

__all__ = ["SPACE", "scratch", "stored", "table", "words"]

#: Runs of characters that are not one of the six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """White-space separated words of a text, unchanged; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")
