"""Session settings shared by the tests, the benchmark and interactive use."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session; on a cluster the submitter's own session is used instead."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config(map=SETTINGS | {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory})
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
