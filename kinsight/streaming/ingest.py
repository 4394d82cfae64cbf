"""Incremental ingestion: a stream of crawl events into a catalog folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType


def crawl_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Crawl events as they arrive as Parquet files; the trigger's bound is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def latest(events: DataFrame) -> DataFrame:
    """The last event of each file: (volume_id, rel_path), by seq."""
    rest = [c for c in events.columns if c not in ("volume_id", "rel_path")]
    return events.groupBy("volume_id", "rel_path").agg(F.max_by(F.struct(*rest), "seq").alias("e")).select("volume_id", "rel_path", "e.*")


def changed(events: DataFrame, known: DataFrame) -> DataFrame:
    """Events whose size or time the catalog does not have yet, so that only they are hashed again."""
    return events.join(known.select("volume_id", "rel_path", "size", "mtime"), ["volume_id", "rel_path", "size", "mtime"], "left_anti")


def ingest(stream: DataFrame, catalog: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append the changed events of each micro-batch to the catalog's log.

    A batch is written under its own number, so one that runs again replaces
    itself; the checkpoint is where a stopped crawl resumes. A file is written
    where its size or time differs from what the batches before have of it.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(catalog)
        events = latest(batch)
        if number and path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            log = spark.read.schema(StructType([*batch.schema.fields, StructField("batch", LongType())])).parquet(catalog)
            events = changed(events, latest(log.where(F.col("batch") < number).drop("batch")))
        events.select(*latest(batch).columns).write.mode("overwrite").parquet(f"{catalog}/batch={number}")
        spark.catalog.clearCache()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def read_catalog(spark: SparkSession, catalog: str) -> DataFrame:
    """The catalog that a log of batches amounts to."""
    log = spark.read.option("mergeSchema", "false").parquet(catalog)
    return latest(log.drop("batch"))


def bursts(events: DataFrame, gap: str = "5 minutes") -> DataFrame:
    """Runs of a user's events with no gap longer than ``gap``; on a stream with a watermark, too."""
    return events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(
        "user_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n", "total"
    )
