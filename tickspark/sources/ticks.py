"""The sharded tick store: a file for each kind, market, symbol and UTC day, or month for sampled tops."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.functions import params
from tickspark.functions.scalar import DAY_NS
from tickspark.sources import schemas
from tickspark.sources.store import entries, exists


def days(start: int, end: int) -> list[datetime]:
    """UTC days that [start, end) touches, in nanoseconds; none if it is empty."""
    if start >= end:
        return []
    first, last = start // DAY_NS, (end - 1) // DAY_NS
    return [datetime(1970, 1, 1, tzinfo=UTC) + timedelta(days=d) for d in range(first, last + 1)]


def day_file(root: str, kind: str, symbol: str, market: str, d: datetime) -> str:
    return f"{root}/{kind}_{market}/{symbol}/{d.year}/{d.month}/bn_{kind}_{market}_{symbol}_{d.year}_{d.month}_{d.day}.parquet"


def day_files(root: str, kind: str, symbol: str, market: str | None, start: int, end: int) -> list[tuple[str, str]]:
    """(market, path) of the days' files in reading order; month and day aren't padded."""
    return [(m, day_file(root, kind, symbol, m, d)) for m in params.markets(market) for d in days(start, end)]


def month_file(root: str, symbol: str, market: str, year: int, month: int) -> str:
    return f"{root}/top_px_{market}/{symbol}/bn_top_px_{market}_{symbol}_{year}_{month}.parquet"


def month_files(root: str, symbol: str, market: str, start: int, end: int) -> list[tuple[str, str]]:
    months = dict.fromkeys((d.year, d.month) for d in days(start, end))
    return [(market, month_file(root, symbol, market, y, m)) for y, m in months]


#: Days that are looked for one by one; for more, the symbol's folders are listed, whatever the range.
FEW_DAYS = 62


def found_files(spark: SparkSession, root: str, kind: str, symbol: str, market: str | None, start: int, end: int, sampled: bool = False) -> dict[str, list[str]]:
    """Existing files of the days in [start, end) by market, in reading order; of sampled tops, those of the months."""
    if start >= end:
        return {}
    first, last = (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(days=t // DAY_NS) for t in (start, end - 1))
    few = (last - first).days < FEW_DAYS
    out: dict[str, list[str]] = {}
    for m in params.markets(market):
        if few:
            own = [p for _, p in (month_files(root, symbol, m, start, end) if sampled else day_files(root, kind, symbol, m, start, end)) if exists(spark, p)]
        elif sampled:
            names = entries(spark, f"{root}/top_px_{m}/{symbol}")
            dated = (re.fullmatch(rf"bn_top_px_{m}_{re.escape(symbol)}_(\d+)_(\d+)\.parquet", n) for n in names)
            months = sorted((int(d[1]), int(d[2])) for d in dated if d)
            own = [month_file(root, symbol, m, y, k) for y, k in months if (first.year, first.month) <= (y, k) <= (last.year, last.month)]
        else:
            folder, own = f"{root}/{kind}_{m}/{symbol}", []
            years = sorted(int(y) for y in entries(spark, folder) if y.isdecimal())
            months = [(y, k) for y in years if first.year <= y <= last.year for k in sorted(int(k) for k in entries(spark, f"{folder}/{y}") if k.isdecimal())]
            for y, k in (x for x in months if (first.year, first.month) <= x <= (last.year, last.month)):
                names = entries(spark, f"{folder}/{y}/{k}")
                dated = (re.fullmatch(rf"bn_{kind}_{m}_{re.escape(symbol)}_{y}_{k}_(\d+)\.parquet", n) for n in names)
                of_days = sorted(datetime(y, k, int(d[1]), tzinfo=UTC) for d in dated if d)
                own += [day_file(root, kind, symbol, m, d) for d in of_days if first <= d <= last]
        if own:
            out[m] = own
    return out


def scan(spark: SparkSession, root: str, kind: str, symbol: str, market: str | None = None, start: int = 0, end: int = (1 << 63) - 1, wanted: str | None = None, sampled: bool = False) -> DataFrame:
    """Rows of [start, end) with the wanted columns and their market; futures come before spot in market_order.

    Only the files of the days are listed; the bounds are also pushed to the row groups, and only the columns wanted are
    read, of nested levels as well. Missing files are skipped; with none there is an empty result.
    """
    schema = schemas.TOP_SAMPLED if sampled else schemas.BY_KIND[kind]
    names = params.columns(kind, wanted)
    if sampled and market is None:
        raise ValueError("sampled tops need a market")
    order = {m: nth for nth, m in enumerate(params.markets(market))}
    out = None
    for name, paths in found_files(spark, root, kind, symbol, market, start, end, sampled).items():
        rows = spark.read.schema(schema).parquet(*paths).where((F.col("ts") >= start) & (F.col("ts") < end))
        rows = rows.select(*(F.col(_level(kind, c)).alias(c) for c in names), F.lit(name).alias("market"), F.lit(order[name]).alias("market_order"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        empty = spark.createDataFrame([], schema)
        out = empty.select(*(F.col(_level(kind, c)).alias(c) for c in names), F.lit("").alias("market"), F.lit(0).alias("market_order"))
    return out


def _level(kind: str, column: str) -> str:
    return column.replace("_", ".") if kind == "depth" and column[:4] in ("ask_", "bid_") else column


def bars(spark: SparkSession, root: str, symbol: str, step: str) -> DataFrame:
    """Files *_<symbol>_<year>_<month>_<step>.parquet at any depth, with year and month of their names."""
    _, label = params.step(step)
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*_{symbol}_*_{label}.parquet").parquet(root)
    name = F.col("_metadata.file_name")
    pattern = rf"_{symbol}_(\d+)_(\d+)_{label}\.parquet$"
    rows = rows.withColumns({"year": F.regexp_extract(name, pattern, 1), "month": F.regexp_extract(name, pattern, 2)}).where("year <> ''")
    return rows.withColumns({"year": F.col("year").cast("int"), "month": F.col("month").cast("int")})


def directory(spark: SparkSession, path: str) -> DataFrame:
    """All *.parquet of a folder, not below it, with their file."""
    return spark.read.option("pathGlobFilter", "*.parquet").parquet(path).withColumn("file", F.col("_metadata.file_path"))


def listed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The files of a list that exist, with their file; fails if none does."""
    return spark.read.parquet(*(p for p in dict.fromkeys(paths) if exists(spark, p))).withColumn("file", F.col("_metadata.file_path"))
