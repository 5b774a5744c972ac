"""Incremental reads: each new file once, its rows to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def new_files(spark: SparkSession, path: str, schema: T.StructType, glob: str = "*.parquet", most: int = 1000) -> DataFrame:
    """Rows of the files that come into a folder, oldest first, at most most files a batch."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", most).parquet(path)


def append(rows: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Writes a stream to Parquet; the checkpoint records what was read, so a restart repeats nothing.

    every: a processing-time interval; none: what is there now, then the query ends.
    """
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
