"""Alignment of several time series: by position, by equal time, and as of each event."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickspark.operators.rows import filled, numbered


def zipped(streams: dict[str, DataFrame], order: list[str], bucket: Column, same: str | None = None) -> DataFrame:
    """Rows of equal position, as <stream>_<column>, down to the shortest stream; with same, only where that column agrees."""
    parts = []
    for name, df in streams.items():
        rows = numbered(df, order, bucket)
        parts.append(rows.select("nth", *(F.col(c).alias(f"{name}_{c}") for c in df.columns)))
    out = reduce(lambda a, b: a.join(b, "nth"), parts)
    if same:
        first, *others = streams
        out = out.where(reduce(Column.__and__, (F.col(f"{first}_{same}") == F.col(f"{o}_{same}") for o in others)))
    return out


def equal_times(streams: dict[str, DataFrame], ts: str, order: list[str]) -> DataFrame:
    """Rows of equal time; of rows of one stream with one time the last in order counts."""
    parts = []
    for name, df in streams.items():
        values = [c for c in df.columns if c != ts]
        last = df.groupBy(ts).agg(F.max(F.struct(*order, *(c for c in values if c not in order))).alias("r"))
        parts.append(last.select(ts, *(F.col(f"r.{c}").alias(f"{name}_{c}") for c in values)))
    return reduce(lambda a, b: a.join(b, ts), parts)


def as_of(streams: dict[str, DataFrame], ts: str, tie: str, columns: list[str], keys: list[str] | None = None, bucket: Column | None = None) -> DataFrame:
    """A row for each event of any stream with the latest columns of all, from when all have one.

    Events are united and filled forward in time, ties in the streams' order, then by tie: one shuffle, and no join on a
    range. Nothing after an event is used. keys are series apart; bucket splits a long one (see filled).
    """
    keys = keys or []
    parts = []
    for nth, (name, df) in enumerate(streams.items()):
        own = [F.struct(*(F.col(c) for c in (ts, *columns))).alias(f"__{s}") if s == name else F.lit(None).alias(f"__{s}") for s in streams]
        parts.append(df.select(*keys, F.col(ts).alias("ts"), F.lit(nth).alias("stream"), F.col(tie).alias("tie"), *own))
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    rows = filled(rows, keys, ["ts", "stream", "tie"], [f"__{s}" for s in streams], bucket)
    rows = rows.where(reduce(Column.__and__, (F.col(f"__{s}").isNotNull() for s in streams)))
    return rows.select(
        *keys, "ts", "stream", "tie", *(F.col(f"__{s}.{c}").alias(f"{s}_{c}") for s in streams for c in columns),
        *((F.col("ts") - F.col(f"__{s}.{ts}")).alias(f"{s}_lag") for s in streams),
    )


def started(streams: dict[str, DataFrame], ts: str) -> DataFrame:
    """One row: the common start, the latest of the streams' first times."""
    firsts = reduce(lambda a, b: a.unionByName(b), (df.agg(F.min(ts).alias("t")) for df in streams.values()))
    return firsts.agg(F.max("t").alias("start"))


def as_of_from_start(streams: dict[str, DataFrame], ts: str, columns: list[str]) -> DataFrame:
    """The merge of a few short streams from their common start, seeded and ended as the recorded runs were.

    A stream's leg starts from the row before its first one at the start or later; a stream without such a row starts
    from its last row and its events begin at its first. Rows end with the event after which the stream that fired has
    no more. Meant for comparison with recorded results: as_of is the operator for data of any size.
    """
    names = list(streams)
    start = started(streams, ts)
    events, seeds = [], []
    for nth, (name, df) in enumerate(streams.items()):
        rows = df.withColumn("k", F.row_number().over(Window.orderBy(ts))).crossJoin(F.broadcast(start))
        rows = rows.withColumn("n", F.count("*").over(Window.partitionBy()))
        rows = rows.withColumn("first", F.min(F.when(F.col(ts) >= F.col("start"), F.col("k"))).over(Window.partitionBy()))
        own = F.struct(*(F.col(c) for c in (ts, *columns)))
        legs = [own.alias(f"__{s}") if s == name else F.lit(None).alias(f"__{s}") for s in names]
        events.append(rows.where(F.col("k") >= F.coalesce("first", F.lit(1))).select(F.col(ts).alias("ts"), F.lit(nth).alias("stream"), "k", (F.col("k") == F.col("n")).alias("ends"), *legs))
        seed = F.greatest(F.coalesce(F.col("first") - 1, F.col("n")), F.lit(1))
        seeds.append(rows.where(F.col("k") == seed).select(own.alias(f"seed_{name}")))
    merged = reduce(lambda a, b: a.unionByName(b), events)
    order = Window.orderBy("ts", "stream", "k")
    past = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = merged.withColumns({f"__{s}": F.last(f"__{s}", ignorenulls=True).over(past) for s in names})
    merged = merged.withColumn("ended", F.coalesce(F.max(F.col("ends").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    merged = merged.where("ended = 0")
    for s in seeds:
        merged = merged.crossJoin(F.broadcast(s))
    merged = merged.withColumns({s: F.coalesce(f"__{s}", f"seed_{s}") for s in names})
    return merged.select("ts", "stream", *(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in names for c in columns))
