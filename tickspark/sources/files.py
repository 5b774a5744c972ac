"""CSV, text and JSON sources."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.functions.scalar import SCALE
from tickspark.sources import schemas
from tickspark.sources.store import exists


def ticks(spark: SparkSession, *paths: str) -> DataFrame:
    """Headerless ticks, prices and quantities as numbers; rows that don't parse, are short or have no spread are dropped."""
    raw = spark.read.text(list(paths)).select(F.split("value", ",").alias("c")).where(F.size("c") >= 6)
    names = [f.name for f in schemas.TICK_CSV.fields]
    rows = raw.select(*(F.expr(f"try_cast(c[{k}] AS BIGINT)").alias(n) for k, n in enumerate(names[:5])))
    rows = rows.where(F.expr(" AND ".join(f"{n} IS NOT NULL" for n in names[:5])) & (F.col("ask_px") > F.col("bid_px")))
    return rows.select("ts", *((F.col(n) / SCALE).alias(n) for n in names[1:5]))


def prices(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.schema(schemas.PRICE_CSV).option("mode", "DROPMALFORMED").csv(list(paths))


def klines(spark: SparkSession, *paths: str) -> DataFrame:
    """Bars of several files, open time in microseconds, from lines of seven fields or more, of which the first seven count.

    Files that don't exist are skipped, and so are lines that are short or don't parse; without any file there is an
    empty result.
    """
    fields = schemas.KLINE_CSV.fields
    found = [p for p in dict.fromkeys(paths) if exists(spark, p)]
    if not found:
        return spark.createDataFrame([], schemas.KLINE_CSV)
    raw = spark.read.text(found).select(F.split("value", ",").alias("c")).where(F.size("c") >= len(fields))
    rows = raw.select(*(F.col("c")[k].try_cast(f.dataType).alias(f.name) for k, f in enumerate(fields)))
    return rows.where(F.expr(" AND ".join(f"{f.name} IS NOT NULL" for f in fields)))


def table(spark: SparkSession, *paths: str) -> DataFrame:
    """Any CSV as strings: commas split, nothing is quoted."""
    return spark.read.text(list(paths)).select(F.split("value", ",", -1).alias("row"))


def first_column(lines: DataFrame, digits_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped) first columns of lines(value)."""
    key = F.split("value", ",")[0]
    rows = lines.select("*", key.alias("key"))
    kept = F.col("key").rlike("^[0-9]+$") if digits_only else F.lit(True)
    return rows.where(kept), rows.where(~kept)


def transactions(raw: DataFrame, column: str = "value") -> DataFrame:
    """(txid, vsize, block_height, block_time) of JSON objects, or arrays of them; vsize is a quarter of the weight, rounded up."""
    one = F.from_json(column, schemas.TRANSACTION)
    many = F.from_json(column, f"array<{schemas.TRANSACTION.simpleString()}>")
    rows = raw.select(F.explode(F.when(F.col(column).rlike(r"^\s*\["), many).otherwise(F.array(one))).alias("t"))
    return rows.select("t.txid", F.expr("(t.weight + 3) div 4").alias("vsize"), "t.status.block_height", "t.status.block_time")


def json_field(column: str, path: str, kind: str, default: object = None) -> Column:
    value = F.get_json_object(column, path).cast(kind)
    return value if default is None else F.coalesce(value, F.lit(default))


def pending(manifest: DataFrame, done: DataFrame) -> DataFrame:
    """Entries with a key whose name isn't recorded yet; process them by t, oldest first."""
    return manifest.where("key IS NOT NULL").join(done.select("name"), "name", "left_anti")


def manifest_with(manifest: DataFrame, new: DataFrame, most: int) -> DataFrame:
    """The newest entries, most of them, the new ones included."""
    return new.unionByName(manifest).orderBy(F.col("t").desc(), "name").limit(most)


#: Compressed and plain bytes that a task holds at a time.
CHUNK = 1 << 20


def zstd_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, value): lines of zstd files, which may be many frames one after another; plain text is a chunk at a time.

    Spark has no codec for them, so an executor takes a file's compressed bytes and gives its lines batch by batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rest = b""
                with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content.as_buffer()), read_across_frames=True) as stream:
                    while chunk := stream.read(CHUNK):
                        *lines, rest = (rest + chunk).split(b"\n")
                        yield pa.record_batch([pa.array([path] * len(lines), pa.string()), pa.array([x.decode() for x in lines], pa.string())], ["file", "value"])
                if rest:
                    yield pa.record_batch([pa.array([path]), pa.array([rest.decode()])], ["file", "value"])

    return spark.read.format("binaryFile").load(list(paths)).select("path", "content").mapInArrow(run, "file string, value string")
