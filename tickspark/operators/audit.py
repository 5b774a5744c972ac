"""Data-quality audits: statistics of each file or series, anomaly rules over them, outliers among files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickspark.operators.rows import lagged
from tickspark.sources.store import written

MS = 1_000_000

#: Names of anomalies as audits report them; {} stands for a column or a number of rows.
OPEN_FAILED, NO_ROWS, OTHER_ROWS = "open_read_failed", "rows_scanned == 0", "rows_scanned != meta_rows"
FEW_SCANNED, SMALL_TRADE, SMALL_DEPTH = "rows_scanned < 90% of meta_rows", "meta_rows < 100 (small file)", "meta_rows < 10 (very small depth file)"
DUPLICATES, NULLS, DEPTH_NULLS, BACKWARDS = "dup_tradeid > 0", "null_counts > 0", "null_counts > 0 (ts/firstId/lastId/eventTime)", "non_monotonic_ts > 0"
GAPS_100MS, GAPS_1S, CROSSED, SAME = "gaps_gt_100ms > 0", "gaps_gt_1s > 0", "cross_book_count > 0 (bid_px > ask_px)", "duplicate_snapshot_count > 0"
IDS_SWAPPED, IDS_OVERLAP, IDS_APART = "lastId < firstId (counted)", "id_overlap_count > 0 (firstId <= prev.lastId)", "id_gap_count > 0 (firstId > prev.lastId+1)"
MANY_ZERO, NO_VALUES, PER_ROW = "high_fraction_{}_zero", "has_{0} but {0}_count==0", "per-row {} counts mismatch rows_scanned"
FLATTENED, OUTLIER = "flattened_bid_or_ask_arrays_without_offsets (informational)", "{} statistical_outlier"


def named(rules: list[tuple[str, Column]]) -> Column:
    """Names of the rules that hold, in order."""
    return F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules)), lambda n: n.isNotNull())


def with_gaps(df: DataFrame, keys: list[str], order: list[str], ts: Column, bucket: Column | None = None, more: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """df with dt, the advance from the row before; 0 where time goes back, which backwards marks. more: further lags."""
    rows = lagged(df.withColumn("__ts", ts), keys, order, {"__t": ("__ts", 1), **(more or {})}, bucket)
    dt = F.col("__ts") - F.col("__t")
    return rows.withColumns({"dt": F.when(dt.isNotNull(), F.greatest(dt, F.lit(0))), "backwards": dt < 0, "repeated": dt == 0}).drop("__t")


def gap_measures(unit: int = MS) -> list[Column]:
    """Largest, mean, 100 ms and 1 s gaps and steps back; unit: how many time units a millisecond has."""
    return [
        F.max("dt").alias("max_gap"), (F.sum("dt") / F.count("dt")).alias("gap_mean"), F.count_if(F.col("dt") >= 100 * unit).alias("gaps_100ms"),
        F.count_if(F.col("dt") >= 1000 * unit).alias("gaps_1s"), F.count_if("backwards").alias("non_monotonic_ts"), F.count_if("repeated").alias("repeated_ts"),
    ]


def value_measures(column: str, spread: bool = False) -> list[Column]:
    c = F.col(column)
    out = [
        F.min(c).alias(f"{column}_min"), F.max(c).alias(f"{column}_max"), F.avg(c).alias(f"{column}_avg"), F.count_if(c == 0).alias(f"{column}_zero"),
        F.count_if(c.isNull()).alias(f"{column}_null"),
    ]
    return [*out, F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{column}_sd")] if spread else out


def with_scores(audit: DataFrame, columns: list[str]) -> DataFrame:
    """audit with z_<column>: deviations from the mean over all rows; 0 where there is no spread.

    The moments are one row, which every task gets; there is no window over all rows. audit, a row for each series, is
    written first, so that it is made once.
    """
    audit = written(audit, "audit")
    moments = audit.agg(*(f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("sd", F.stddev_samp))))
    rows = audit.crossJoin(F.broadcast(moments))
    score = {f"z_{c}": F.when(F.col(f"__sd_{c}") > 0, F.abs((F.col(c) - F.col(f"__mean_{c}")) / F.col(f"__sd_{c}"))).otherwise(0.0) for c in columns}
    return rows.withColumns(score).drop(*(f"__{n}_{c}" for c in columns for n in ("mean", "sd")))


def with_footers(audit: DataFrame, footers: DataFrame, key: str = "file") -> DataFrame:
    """audit with meta_rows, row_groups and the row ratio; files without rows come in with rows 0."""
    rows = footers.join(audit, key, "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    return rows.withColumn("rows_ratio", F.when(F.col("meta_rows") > 0, F.col("rows") / F.col("meta_rows")))


def _first(meta: bool) -> list[tuple[str, Column]]:
    none = (NO_ROWS, F.col("rows") == 0)
    return [(OPEN_FAILED, F.col("open_failed")), none, (OTHER_ROWS, F.col("rows") != F.col("meta_rows"))] if meta else [none]


def _small(meta: bool, name: str, rows: int) -> list[tuple[str, Column]]:
    return [(name, (F.col("meta_rows") > 0) & (F.col("meta_rows") < rows))] if meta else []


def outliers(scored: dict[str, str], most: float = 3.0) -> list[tuple[str, Column]]:
    """Rules on the scores of columns, by the names that they are reported under."""
    return [(OUTLIER.format(name), F.col(f"z_{c}") > most) for c, name in scored.items()]


def trade_audit(df: DataFrame, keys: list[str], order: list[str], ts: Column, px: str, qty: str, id_: str, unit: int = MS, footers: DataFrame | None = None, bucket: Column | None = None) -> DataFrame:
    """Statistics and anomalies of each series of trades; see with_last for bucket."""
    rows = with_gaps(df, keys, order, ts, bucket)
    audit = rows.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.min("__ts").alias("ts_min"), F.max("__ts").alias("ts_max"), F.count_if(F.col("__ts").isNull()).alias("ts_null"),
        *gap_measures(unit), *value_measures(px), *value_measures(qty), F.min(id_).alias("id_min"), F.max(id_).alias("id_max"),
        F.count_if(F.col(id_).isNull()).alias("id_null"), (F.count(id_) - F.count_distinct(F.col(id_))).alias("dup_ids"),
    )
    scored, meta = {"max_gap": "max_gap_ns", "gap_mean": "gap_mean", f"{px}_avg": "px_avg", f"{qty}_avg": "qty_avg"}, footers is not None
    if meta:
        audit, scored = with_footers(audit, footers), {"rows_ratio": "rows_ratio", **scored}
    audit = with_scores(audit, list(scored))
    nulls = F.col("ts_null") + F.col(f"{px}_null") + F.col(f"{qty}_null") + F.col("id_null") > 0
    rules = [
        *_first(meta), (DUPLICATES, F.col("dup_ids") > 0), (NULLS, nulls), (BACKWARDS, F.col("non_monotonic_ts") > 0), *([(FEW_SCANNED, F.col("rows_ratio") < 0.9)] if meta else []),
        *_small(meta, SMALL_TRADE, 100), *outliers(scored),
    ]
    return audit.withColumn("anomalies", named(rules))


BOOK = ["bid_px", "bid_qty", "ask_px", "ask_qty"]


def top_audit(df: DataFrame, keys: list[str], order: list[str], ts: Column, unit: int = MS, footers: DataFrame | None = None, bucket: Column | None = None) -> DataFrame:
    """Statistics and anomalies of each series of best bids and asks; df has BOOK and valu."""
    rows = with_gaps(df.withColumn("__own", F.struct(*BOOK)), keys, order, ts, bucket, {"__last": ("__own", 1)}).withColumn("same", F.col("__own") == F.col("__last"))
    audit = rows.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.min("__ts").alias("ts_min"), F.max("__ts").alias("ts_max"), F.count_if(F.col("__ts").isNull()).alias("ts_null"), *gap_measures(unit),
        *(m for c in (*BOOK, "valu") for m in value_measures(c, spread=True)), *crossed("bid_px", "ask_px"), F.count_if("same").alias("duplicate_snapshots"),
    )
    scored, meta = {"bid_px_avg": "px_avg", "bid_qty_avg": "qty_avg", "max_gap": "max_gap_ns"}, footers is not None
    if meta:
        audit, scored = with_footers(audit, footers), {"rows_ratio": "rows_ratio", **scored}
    audit = with_scores(audit, list(scored))
    nulls = sum((F.col(f"{c}_null") for c in (*BOOK, "valu")), F.col("ts_null")) > 0
    rules = [
        *_first(meta), (NULLS, nulls), (BACKWARDS, F.col("non_monotonic_ts") > 0), (GAPS_100MS, F.col("gaps_100ms") > 0), (GAPS_1S, F.col("gaps_1s") > 0),
        (CROSSED, F.col("crossed") > 0), (SAME, F.col("duplicate_snapshots") > 0),
        *((MANY_ZERO.format(c), F.col(f"{c}_zero") * 10 > F.col("rows") - F.col(f"{c}_null")) for c in ("bid_px", "ask_px", "bid_qty", "ask_qty")),
        *_small(meta, SMALL_TRADE, 100), *outliers(scored),
    ]
    return audit.withColumn("anomalies", named(rules))


def crossed(bid: str, ask: str) -> list[Column]:
    """Books with the bid over the ask, and with it at the ask or over."""
    return [F.count_if(F.col(bid) > F.col(ask)).alias("crossed"), F.count_if(F.col(bid) >= F.col(ask)).alias("crossed_or_touching")]


def id_checks(first: str, last: str, before: str) -> dict[str, Column]:
    """Faults of update ids, before being the last id of the row before."""
    return {"last_lt_first": F.col(last) < F.col(first), "id_overlap": F.col(first) <= F.col(before), "id_gap": F.col(first) > F.col(before) + 1}


def with_id_checks(df: DataFrame, keys: list[str], order: list[str], first: str = "firstId", last: str = "lastId", bucket: Column | None = None) -> DataFrame:
    return lagged(df, keys, order, {"__before": (last, 1)}, bucket).withColumns(id_checks(first, last, "__before")).drop("__before")


def side_measures(side: str) -> list[Column]:
    """Of an array of levels: elements, zeros, extremes and sums of px and qty, empty rows; no explode."""
    c = F.col(side)
    out = [F.sum(F.size(c)).alias(f"{side}_levels"), F.count_if(F.size(c) == 0).alias(f"{side}_empty")]
    for field in ("px", "qty"):
        values = c.getField(field)
        out += [
            F.sum(F.size(F.filter(values, lambda x: x.isNotNull()))).alias(f"{side}_{field}_count"),
            F.min(F.array_min(values)).alias(f"{side}_{field}_min"), F.max(F.array_max(values)).alias(f"{side}_{field}_max"),
            F.sum(F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x, F.lit(0)))).alias(f"{side}_{field}_sum"),
            F.sum(F.size(F.filter(values, lambda x: x == 0))).alias(f"{side}_{field}_zero"),
        ]
    return out


def depth_audit(df: DataFrame, keys: list[str], order: list[str], ts: Column, unit: int = MS, footers: DataFrame | None = None, bucket: Column | None = None) -> DataFrame:
    """Statistics and anomalies of each series of book updates; df has firstId, lastId, ask and bid.

    Of files in a flattened layout df may also have the booleans bid_per_row and ask_per_row (false: values without
    offsets, which can't be told by row); in the nested layout every row has its levels.
    """
    flat = {s: F.col(f"{s}_per_row") if f"{s}_per_row" in df.columns else F.lit(None).cast("boolean") for s in ("bid", "ask")}
    # the first levels' price, and whether it jumps over tenfold
    sample = F.coalesce(F.get(F.col("ask"), F.lit(0))["px"], F.get(F.col("bid"), F.lit(0))["px"])
    rows = df.withColumns({"sample_px": sample, "first_bid": F.get(F.col("bid"), F.lit(0))["px"], "first_ask": F.get(F.col("ask"), F.lit(0))["px"]})
    rows = with_gaps(rows, keys, order, ts, bucket, {"__before": ("lastId", 1), "__px": ("sample_px", 1)})
    rows = rows.withColumns({**id_checks("firstId", "lastId", "__before"), "jump": jump(F.col("sample_px"), F.col("__px"))})
    first_qty = F.get(F.col("ask"), F.lit(0))["qty"]
    audit = rows.groupBy(*keys).agg(
        F.count("*").alias("rows"), *gap_measures(unit), F.count_if(F.col("__ts").isNull() | F.col("firstId").isNull() | F.col("lastId").isNull()).alias("id_null"),
        *(F.count_if(c).alias(c) for c in ("last_lt_first", "id_overlap", "id_gap")), *side_measures("ask"), *side_measures("bid"), F.count_if("jump").alias("jumps"),
        *crossed("first_bid", "first_ask"), F.count_if(F.col("sample_px") % 1000 != 0).alias("px_not_div1000"), F.count_if(first_qty % 100_000_000 != 0).alias("qty_not_div1e8"),
        *(F.bool_and(c).alias(f"{s}_per_row") for s, c in flat.items()),
    )
    meta = footers is not None
    if meta:
        audit = with_footers(audit, footers)
    values = [f"{s}_{f}" for f in ("px", "qty") for s in ("bid", "ask")]
    per_row = {s: F.col(f"{s}_per_row") & (F.col(f"{s}_px_count") != F.col("rows")) & (F.col(f"{s}_qty_count") != F.col("rows")) for s in ("bid", "ask")}
    flattened = reduce(Column.__or__, (~F.col(f"{s}_per_row") & (F.col(f"{s}_{f}_count") > 0) for s in ("bid", "ask") for f in ("px", "qty")))
    rules = [
        *_first(meta), (DEPTH_NULLS, F.col("id_null") > 0), (BACKWARDS, F.col("non_monotonic_ts") > 0), (IDS_SWAPPED, F.col("last_lt_first") > 0),
        (IDS_OVERLAP, F.col("id_overlap") > 0), (IDS_APART, F.col("id_gap") > 0), *((NO_VALUES.format(v), F.col(f"{v}_count") == 0) for v in values),
        *((MANY_ZERO.format(f"{s}_{f}"), F.col(f"{s}_{f}_zero") * 10 > F.col(f"{s}_{f}_count")) for f in ("qty", "px") for s in ("bid", "ask")),
        *((PER_ROW.format(s), c) for s, c in per_row.items()), (FLATTENED, flattened), *_small(meta, SMALL_DEPTH, 10),
    ]
    information = F.coalesce(flattened, F.lit(False)) | F.coalesce(per_row["bid"] | per_row["ask"], F.lit(False))
    return audit.withColumn("anomalies", named(rules)).withColumns({"problematic": problematic(), "problematic_with_info": problematic(information)})


def problematic(information: Column | None = None) -> Column:
    """Whether a depth audit is worth a report; information flags count only if given."""
    counts = ("non_monotonic_ts", "last_lt_first", "id_overlap", "id_gap", "bid_qty_zero", "ask_qty_zero", "bid_px_zero", "ask_px_zero", "crossed_or_touching", "jumps", "px_not_div1000", "qty_not_div1e8")
    out = sum((F.coalesce(F.col(c), F.lit(0)) for c in counts), F.coalesce(F.col("bid_empty") + F.col("ask_empty"), F.lit(0))) > 0
    return out if information is None else out | information


def jump(value: Column, before: Column, times: int = 10) -> Column:
    """Whether two neighbouring positive values are over times apart, up or down."""
    return (value > 0) & (before > 0) & (F.greatest(value, before) > times * F.least(value, before))


def offset_faults(df: DataFrame, keys: list[str], offsets: str, rows: str) -> DataFrame:
    """Row groups of the flattened layout whose offsets aren't one more than their rows."""
    return df.groupBy(*keys).agg(F.count_if(F.size(offsets) != F.col(rows) + 1).alias("offset_faults"))
