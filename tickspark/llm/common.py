"""What several corpus operators share: written intermediates and connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterator
from functools import cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickspark.sources import store


#: Bytes of an Arrow batch while a table is written: a batch of long texts is in memory several times over.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, and lost executors cost nothing done so far."""
    conf = df.sparkSession.conf
    before = conf.get(BATCH_SETTING)
    conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")
    try:
        return store.written(df, name)
    finally:
        conf.set(BATCH_SETTING, before)


def slices(batch: pa.RecordBatch, rows: int = 64) -> Iterator[pa.RecordBatch]:
    """A batch in parts, so that few texts at a time become Python objects."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


#: What this worker keeps from task to task: of one operator at a time.
_KEPT: dict[Hashable, Any] = {}


def worker_kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """make()'s result, kept for later tasks of this worker that name key; what was kept for another key goes."""
    if key not in _KEPT:
        forget()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    _KEPT.clear()


@cache
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):  # not glibc
        return lambda _: 0


def give_back() -> None:
    """Gives the system the memory that this worker has freed: workers stay from stage to stage, allocators keep it."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def tidy(run):
    """run, for mapInArrow, in a worker that keeps nothing of other operators, and whose freed memory goes back after it."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """name, behind as many underscores as no column of df has it, in any case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def small_side(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """df, a written table, marked to be sent to every task if it has at most most rows."""
    return F.broadcast(df) if df.count() <= most else df


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node in edges; root is the smallest node reachable.

    Large-star and small-star steps (Kiveris et al., 2014) alternate until nothing changes. Each step is one
    aggregation, with partial minima before the shuffle, and one join, whose hot side AQE can split; no step brings a
    component together. Edges with a null end are ignored, as are loops and repeats.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    e, at = store.written_at(e, "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        # both smaller neighbours and u itself move to the smallest neighbour of u
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where("u > v").distinct()
        )
        done = at
        e, at = store.written_at(small, "edges")
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        store.drop_tables(edges.sparkSession, [done])
        if before is not None and (now.n, now.h) == before:
            break
        before = (now.n, now.h)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def picked(df: DataFrame, by: str, id_: str, most: int, spare: int = 4) -> DataFrame:
    """At most most rows of each value of by, those of least hash of id_.

    A first pass counts the rows of a value; those whose hash is beyond what spare times most rows have aren't
    shuffled, so that a frequent value is no more work for a task than a rare one.
    """
    counts = written(df.groupBy(by).agg(F.count("*").alias("__n")), "counts")
    share = F.pmod(F.xxhash64(F.col(id_)), F.lit(1 << 52)) / F.lit(1 << 52)
    rows = df.withColumn("__h", share).join(small_side(counts, 100_000), by).where(F.col("__h") * F.col("__n") <= spare * most)
    order = Window.partitionBy(by).orderBy("__h", id_)
    return rows.withColumn("__nth", F.row_number().over(order)).where(F.col("__nth") <= most).select(*df.columns)
