"""Session construction shared by tests, the bench and local runs."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that hold at any size; cluster sizing is left to the cluster.
BASE = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(app: str = "kinsight", cpus: int | None = None, shuffle: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A local session; on a cluster use the session that the cluster made."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in (BASE | {"spark.sql.shuffle.partitions": str(shuffle), "spark.driver.memory": memory} | extra).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
