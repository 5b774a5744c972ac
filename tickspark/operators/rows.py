"""Row-wise operators over ordered series: ranges, numbering, sampling, gaps, edges, rolling and running statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tickspark.sources.store import written


def in_range(ts: str, start: object, end: object) -> Column:
    """Half-open; reaches the scan as bounds on ts."""
    return (F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end))


def numbered(df: DataFrame, order: list[str], bucket: Column, name: str = "nth") -> DataFrame:
    """df with the row number in the whole order, from 1.

    bucket must not decrease in that order (say, the day of a time): rows are numbered within buckets, and the buckets'
    counts, a small table, give the offsets, so that no task sees all rows.
    """
    rows = df.withColumn("__bucket", bucket)
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("__bucket").agg(F.count("*").alias("__n"))
    offsets = counts.select(F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order))
    joined = rows.withColumn("__within", within).join(offsets, F.col("__bucket").eqNullSafe(F.col("__b")))
    return joined.withColumn(name, F.col("__before") + F.col("__within")).drop("__bucket", "__b", "__before", "__within")


def with_last(df: DataFrame, keys: list[str], order: list[str], n: int, bucket: Column) -> DataFrame:
    """df with __bucket and __guest: to each bucket of a series come the n rows before it, as guests.

    bucket must not decrease in the order (say, the day of a time), which is total. A task then has a bucket and n rows,
    however long the series is. The last n rows of n buckets are enough, as each has one at least. df is written first,
    as it is read twice: steps behind one another then cost a write each, not twice what came before.
    """
    rows = written(df.withColumn("__bucket", bucket), "series")
    own = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("r")
    nth = F.row_number().over(Window.partitionBy(*keys, "__bucket").orderBy(*(F.col(c).desc() for c in order)))
    last = rows.withColumn("__nth", nth).where(F.col("__nth") <= n)
    tails = last.groupBy(*keys, "__bucket").agg(F.array_sort(F.collect_list(F.struct((-F.col("__nth")).alias("at"), own))).alias("__tail"))
    before = F.flatten(F.collect_list("__tail").over(Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(-n, -1)))
    tails = tails.withColumn("__all", before)
    guests = tails.select("__bucket", F.explode(F.slice("__all", F.greatest(F.size("__all") - n + 1, F.lit(1)), n)).alias("g"))
    guests = guests.select(*(F.col(f"g.r.`{c}`").alias(c) for c in df.columns), "__bucket", F.lit(True).alias("__guest"))
    return rows.withColumn("__guest", F.lit(False)).unionByName(guests)


def lagged(df: DataFrame, keys: list[str], order: list[str], lags: dict[str, tuple[str, int]], bucket: Column | None = None) -> DataFrame:
    """df with columns name: (column, k), the column k rows before in the series; see with_last for bucket."""
    n = max(k for _, k in lags.values())
    rows = df if bucket is None else with_last(df, keys, order, n, bucket)
    w = Window.partitionBy(*keys, *(["__bucket"] if bucket is not None else [])).orderBy(*order)
    rows = rows.withColumns({name: F.lag(c, k).over(w) for name, (c, k) in lags.items()})
    return rows if bucket is None else rows.where("NOT __guest").drop("__bucket", "__guest")


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], bucket: Column | None = None, own: bool = True) -> DataFrame:
    """df with the sum of each expression over the series up to the row, itself included if own; null where there is none.

    With a bucket that doesn't decrease in the order, each bucket is summed by itself, from the sums of those before.
    """
    end = Window.currentRow if own else -1
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
        return df.withColumns({n: F.sum(c).over(w) for n, c in sums.items()})
    rows = written(df.withColumn("__bucket", bucket), "series")
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "__bucket").agg(*(F.sum(c).alias(f"__{n}") for n, c in sums.items()))
    totals = totals.select(*(F.col(k).alias(f"__of_{k}") for k in keys), F.col("__bucket").alias("__of"), *(F.sum(f"__{n}").over(before).alias(f"__{n}") for n in sums))
    w = Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    rows = rows.withColumns({n: F.sum(c).over(w) for n, c in sums.items()})
    one = F.col("__bucket").eqNullSafe(F.col("__of"))
    for k in keys:
        one = one & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    rows = rows.join(totals, one)
    made = {n: F.coalesce(F.col(n) + F.col(f"__{n}"), F.col(n), F.col(f"__{n}")) for n in sums}
    return rows.withColumns(made).select(*df.columns, *sums)


def every_nth(df: DataFrame, n: int, order: list[str], bucket: Column, name: str = "nth") -> DataFrame:
    return numbered(df, order, bucket, name).where(F.col(name) % n == 0)


def tail(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The last n rows in ascending order; each task keeps n."""
    last = df.orderBy(*(c.desc() for c in order)).limit(n)
    return last.orderBy(*(c.asc() for c in order))


def gap_report(df: DataFrame, keys: list[str], order: list[str], at: Column, gap: int, columns: list[str], edges: bool = True, bucket: Column | None = None) -> DataFrame:
    """Neighbouring rows of a series at least gap apart, as first_* and last_* with gap.

    With edges, the first and last row of each series are reported with themselves and gap 0.
    """
    own = F.struct(*(F.col(c) for c in columns))
    rows = df.withColumns({"__at": at, "__own": own}).select(*keys, *(c for c in order if c not in keys), "__at", "__own")
    near = lagged(rows, keys, order, {"__last": ("__own", 1), "__t": ("__at", 1)}, bucket).withColumn("gap", (F.col("__at") - F.col("__t")).cast("long"))
    found = near.where(F.col("gap") >= gap).select(*keys, F.lit("gap").alias("kind"), F.col("__last").alias("a"), F.col("__own").alias("b"), "gap")
    if edges:
        place = F.struct(*order)
        ends = rows.groupBy(*keys).agg(F.min_by("__own", place).alias("first"), F.max_by("__own", place).alias("last"))
        for kind in ("first", "last"):
            found = found.unionByName(ends.select(*keys, F.lit(kind).alias("kind"), F.col(kind).alias("a"), F.col(kind).alias("b"), F.lit(0).cast("long").alias("gap")))
    return found.select(*keys, "kind", *(F.col(f"{side}.{c}").alias(f"{name}_{c}") for side, name in (("a", "first"), ("b", "last")) for c in columns), "gap")


def gap_seconds(gap_ns: Column) -> Column:
    return F.format_string("%.3f", gap_ns / 1e9)


def spikes(df: DataFrame, keys: list[str], order: list[str], value: Column, rows: int = 10, times: int = 2, bucket: Column | None = None) -> DataFrame:
    """Rows whose integer value is over times the mean of the last rows ones, itself included, once there are so many."""
    own = df.withColumn("__v", value)
    if bucket is not None:
        own = with_last(own, keys, order, rows - 1, bucket)
    w = Window.partitionBy(*keys, *(["__bucket"] if bucket is not None else [])).orderBy(*order).rowsBetween(-(rows - 1), 0)
    own = own.withColumns({"rolling_sum": F.sum("__v").over(w), "__n": F.count("*").over(w)})
    own = own if bucket is None else own.where("NOT __guest")
    return own.where((F.col("__n") == rows) & (F.col("__v") * rows > F.col("rolling_sum") * times)).select(*df.columns, "rolling_sum")


def above_mean_so_far(df: DataFrame, keys: list[str], order: list[str], value: Column, bucket: Column | None = None) -> DataFrame:
    """How many integer values of each series are greater than the mean of all before; the first never counts."""
    own = running(df.withColumn("__v", value), keys, order, {"__sum": F.col("__v"), "__n": F.lit(1)}, bucket, own=False)
    return own.groupBy(*keys).agg(F.count_if(F.coalesce(F.col("__v") * F.col("__n") > F.col("__sum"), F.lit(False))).alias("above"))


def running_mean(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str = "running_mean", bucket: Column | None = None) -> DataFrame:
    own = running(df, keys, order, {"__sum": value, "__n": value.isNotNull().cast("long")}, bucket)
    return own.withColumn(name, F.col("__sum") / F.col("__n")).drop("__sum", "__n")


def extremes(df: DataFrame, keys: list[str], ts: str, columns: list[str]) -> DataFrame:
    """Least and largest value of each column with the earliest time at which it had it."""
    made = []
    for c in columns:
        made += [
            F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"),
            F.min(F.struct(F.col(c), F.col(ts)))[ts].alias(f"min_{c}_ts"),
            (-F.max(F.struct(F.col(c), (-F.col(ts)).alias("t")))["t"]).alias(f"max_{c}_ts"),
        ]
    return df.groupBy(*keys).agg(*made)


def filled(df: DataFrame, keys: list[str], order: list[str], columns: list[str], bucket: Column | None = None) -> DataFrame:
    """df with nulls of columns replaced by the last value before in the series.

    With a bucket that doesn't decrease in the order (a day), each bucket is filled by itself and starts from the last
    values of the buckets before, which are few: a long series then is many tasks' work.
    """
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})
    rows = df.withColumn("__bucket", bucket)
    w = Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    order_of = F.struct(*order)
    last = rows.groupBy(*keys, "__bucket").agg(*(F.max(F.when(F.col(c).isNotNull(), F.struct(order_of.alias("o"), F.col(c).alias("v"))))["v"].alias(f"__{c}") for c in columns))
    before: WindowSpec = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*keys, "__bucket", *(F.last(f"__{c}", ignorenulls=True).over(before).alias(f"__{c}") for c in columns))
    rows = rows.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns}).join(carried, [*keys, "__bucket"])
    return rows.withColumns({c: F.coalesce(c, f"__{c}") for c in columns}).drop("__bucket", *(f"__{c}" for c in columns))


def segments(df: DataFrame, keys: list[str], order: list[str], at: Column, most: int, valid: Column | None = None, bucket: Column | None = None) -> DataFrame:
    """df with segment (from 0) and starts: a new one at a series' start, an invalid row, no advance, or an advance over most."""
    rows = df.withColumns({"__at": at, "__ok": F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))})
    rows = lagged(rows, keys, order, {"__t": ("__at", 1), "__valid": ("__ok", 1)}, bucket)
    dt = F.col("__at") - F.col("__t")
    fresh = dt.isNull() | (dt <= 0) | (dt > most) | ~F.col("__ok") | ~F.coalesce("__valid", F.lit(False))
    rows = running(rows.withColumn("starts", fresh), keys, order, {"segment": F.col("starts").cast("int")}, bucket)
    return rows.withColumn("segment", F.col("segment") - 1).where("__ok").drop("__at", "__ok", "__t", "__valid")


def book_walk(df: DataFrame, keys: list[str], order: list[str], px: Column, qty: Column, cash: float, fee: float) -> DataFrame:
    """Fills of a cash amount against levels in order: bought quantity and cost, fee included, until the cash is spent."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumns({"level_cost": px * qty * (1 + fee)})
    rows = rows.withColumn("spent_before", F.coalesce(F.sum("level_cost").over(w), F.lit(0.0))).where(F.col("spent_before") < cash)
    cost = F.least(F.col("level_cost"), cash - F.col("spent_before"))
    return rows.withColumns({"cost": cost, "bought": cost / (px * (1 + fee))})


def ladder(df: DataFrame, mid: Column, step: Column, qty: Column, free: Column, most: int) -> DataFrame:
    """Levels mid - (i + 1) step, while the capital left covers the price times qty."""
    rows = df.withColumns({"__mid": mid, "__step": step, "__qty": qty, "__free": free}).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    n, price = F.col("level") + 1, F.col("__mid") - (F.col("level") + 1) * F.col("__step")
    needed = F.col("__qty") * (n * F.col("__mid") - F.col("__step") * n * (n + 1) / 2)
    return rows.withColumns({"price": price, "needed": needed}).where((F.col("needed") <= F.col("__free")) & (F.col("price") > 0)).drop("__mid", "__step", "__qty", "__free")
