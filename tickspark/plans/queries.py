"""Queries of the engine's operators on the test tables, each with the SQL that gives the same rows.

and orders are total, so that the order of additions and ties can't change a result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickspark.functions import params, scalar
from tickspark.operators import aggregates, algos, align, arbitrage, arma, audit, rows, sorting
from tickspark.sources import files, sinks, store, ticks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(column: str, scale: int = 100) -> Column:
    return F.round(F.col(column) * scale).cast("long")


def day(ts: str) -> Column:
    return F.floor(scalar.micros(ts) / 86_400_000_000)


#: The day of events' us: a bucket for series over time.
DAY_US = 86_400_000_000


def us_day() -> Column:
    return F.floor(F.col("us") / DAY_US)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("us", scalar.micros("ts"))


#: Lines of an order in an order that no two share but equal ones.
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
LINE_SQL = ", ".join(LINE)


@query("SELECT event_id, epoch_us(ts) AS us, value FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'")
def range_scan(spark, sf_dir):  # S3 S4 F2
    start, end = (F.expr(f"TIMESTAMP_NTZ '2024-01-{d} 00:00:00'") for d in ("05", "12"))
    own = table(spark, sf_dir, "events").where(rows.in_range("ts", start, end))
    return own.select("event_id", scalar.micros("ts").alias("us"), "value")


@query("SELECT l_extendedprice AS px, l_quantity AS qty, l_orderkey AS \"tradeId\" FROM lineitem")
def column_alias_select(spark, sf_dir):  # F1
    names = {"px": "l_extendedprice", "qty": "l_quantity", "tradeId": "l_orderkey", "ts": "l_shipdate"}
    wanted = params.columns("trade", "Price, SIZE, tid, no_such_column")
    return table(spark, sf_dir, "lineitem").select(*(F.col(names[c]).alias(c) for c in wanted))


@query("SELECT event_id, nth FROM (SELECT event_id, CAST(row_number() OVER (ORDER BY ts, event_id) AS BIGINT) AS nth FROM events) WHERE nth % 100 = 0")
def every_nth(spark, sf_dir):  # F8 W13 K8
    return rows.every_nth(table(spark, sf_dir, "events"), 100, ["ts", "event_id"], day("ts")).select("event_id", "nth")


@query("SELECT event_id, epoch_us(ts) * 1000 AS ns, epoch_us(ts) * 1000 - (epoch_us(ts) * 1000) % 86400000000000 AS day_ns FROM events")
def ns_epoch(spark, sf_dir):  # C4
    return table(spark, sf_dir, "events").select("event_id", scalar.nanos("ts").alias("ns"), scalar.day_start(scalar.nanos("ts")).alias("day_ns"))


@query("""SELECT event_id, strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso,
    strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || '000' AS full_ns FROM events""")
def iso_format(spark, sf_dir):  # C1 C2 C3
    ns = scalar.nanos("ts")
    return table(spark, sf_dir, "events").select("event_id", scalar.iso_ms(ns).alias("iso"), scalar.full_ns(ns).alias("full_ns"))


@query("""SELECT event_id, CAST(event_id AS VARCHAR) || ';' || strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z;' || printf('%.8f', value) AS line
    FROM events""")
def reader_lines(spark, sf_dir):  # K6 K9 C5
    px = scalar.fixed(cents("value", 100) * 1_000_000)
    return table(spark, sf_dir, "events").select("event_id", sinks.reader_line([F.col("event_id"), sinks.shown_time(scalar.nanos("ts")), px]).alias("line"))


GAPS_SQL = """
WITH w AS (SELECT user_id, event_id, epoch_us(ts) AS us, lag(event_id) OVER o AS a, lag(epoch_us(ts)) OVER o AS a_us, lead(event_id) OVER o AS n
           FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, 'gap' AS kind, a AS first_event_id, a_us AS first_us, event_id AS last_event_id, us AS last_us, us - a_us AS gap FROM w WHERE us - a_us >= 43200000000
"""


@query(GAPS_SQL)
def gap_report(spark, sf_dir):  # W1 W2
    return rows.gap_report(events(spark, sf_dir), ["user_id"], ["us", "event_id"], F.col("us"), 43_200_000_000, ["event_id", "us"], edges=False, bucket=us_day())


@query(GAPS_SQL + """UNION ALL SELECT user_id, 'first', event_id, us, event_id, us, 0 FROM w WHERE a IS NULL
UNION ALL SELECT user_id, 'last', event_id, us, event_id, us, 0 FROM w WHERE n IS NULL""")
def edge_rows(spark, sf_dir):  # W1
    return rows.gap_report(events(spark, sf_dir), ["user_id"], ["us", "event_id"], F.col("us"), 43_200_000_000, ["event_id", "us"], bucket=us_day())


#: Rules on trades in SQL, by name; meta: with what footers tell.
TRADE_RULES = {
    "dup_tradeid > 0": "dup_ids > 0", "null_counts > 0": "px_null + qty_null + id_null > 0", "non_monotonic_ts > 0": "non_monotonic_ts > 0",
    "max_gap_ns statistical_outlier": "zg > 3", "gap_mean statistical_outlier": "zm > 3", "px_avg statistical_outlier": "zp > 3", "qty_avg statistical_outlier": "zq > 3",
}
META_RULES = {"open_read_failed": "open_failed", "rows_scanned == 0": "n = 0", "rows_scanned != meta_rows": "n <> meta_rows"}
SIZE_RULES = {"rows_scanned < 90% of meta_rows": "n < 0.9 * meta_rows", "meta_rows < 100 (small file)": "meta_rows > 0 AND meta_rows < 100"}


def rules_sql(rules: dict[str, str]) -> str:
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in rules.items()) + ")"


def score_sql(column: str) -> str:
    return f"CASE WHEN stddev_samp({column}) OVER () > 0 THEN abs({column} - avg({column}) OVER ()) / stddev_samp({column}) OVER () ELSE 0 END"


#: Measures of trades(px, qty, id, d) in SQL; qty and id have nulls, ids come twice.
TRADE_MEASURES = """count(*) AS n, max(greatest(d, 0)) AS max_gap, CAST(sum(greatest(d, 0)) AS DOUBLE) / count(d) AS gap_mean,
    count(*) FILTER (d < 0) AS non_monotonic_ts, min(px) AS px_min, max(px) AS px_max, avg(px) AS px_avg, avg(qty) AS qty_avg, count(*) FILTER (px IS NULL) AS px_null,
    count(*) FILTER (qty IS NULL) AS qty_null, count(*) FILTER (qty = 0) AS qty_zero, min(id) AS id_min, max(id) AS id_max, count(*) FILTER (id IS NULL) AS id_null, count(id) - count(DISTINCT id) AS dup_ids"""
TRADE_SCORES = f"{score_sql('max_gap')} AS zg, {score_sql('gap_mean')} AS zm, {score_sql('px_avg')} AS zp, {score_sql('qty_avg')} AS zq"
TRADE_SQL = "CAST(round(value * 100) AS BIGINT) AS px, NULLIF(CAST(json_extract(props, '$.k') AS BIGINT), 3) AS qty, CASE WHEN event_id % 500 <> 7 THEN event_id - (event_id % 90 = 1)::INT END AS id"


def _trades(spark, sf_dir):
    k, twice = files.json_field("props", "$.k", "long"), (F.col("event_id") % 90 == 1).cast("int")
    return events(spark, sf_dir).withColumns({
        "px": cents("value"), "qty": F.when(k != 3, k), "id": F.when(F.col("event_id") % 500 != 7, F.col("event_id") - twice),
    })


TRADE_NAMES = ["max_gap", "gap_mean", "non_monotonic_ts", "px_min", "px_max", "px_avg", "qty_avg", "px_null", "qty_null", "qty_zero", "id_min", "id_max", "id_null", "dup_ids"]


@query(f"""
WITH w AS (SELECT *, {TRADE_SQL}, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events),
m AS (SELECT user_id, {TRADE_MEASURES}, min(epoch_us(ts)) AS ts_min, max(epoch_us(ts)) AS ts_max, count(*) FILTER (d >= 100000) AS gaps_100ms, count(*) FILTER (d >= 1000000) AS gaps_1s FROM w GROUP BY user_id),
z AS (SELECT *, {TRADE_SCORES} FROM m)
SELECT user_id, n AS "rows", ts_min, ts_max, gaps_100ms, gaps_1s, {', '.join(TRADE_NAMES)}, {rules_sql({"rows_scanned == 0": "n = 0"} | TRADE_RULES)} AS anomalies FROM z""")
def trade_audit(spark, sf_dir):  # A1-A7 A19 R1 R6 K3
    out = audit.trade_audit(_trades(spark, sf_dir), ["user_id"], ["us", "event_id"], F.col("us"), "px", "qty", "id", unit=1000, bucket=us_day())
    return out.select("user_id", "rows", "ts_min", "ts_max", "gaps_100ms", "gaps_1s", *TRADE_NAMES, F.array_join("anomalies", "|").alias("anomalies"))


#: Rules on best bids and asks in SQL.
TOP_RULES = {
    "rows_scanned == 0": "n = 0", "null_counts > 0": "valu_null > 0", "non_monotonic_ts > 0": "non_monotonic_ts > 0", "gaps_gt_100ms > 0": "gaps_100ms > 0", "gaps_gt_1s > 0": "gaps_1s > 0",
    "cross_book_count > 0 (bid_px > ask_px)": "crossed > 0", "duplicate_snapshot_count > 0": "duplicate_snapshots > 0",
    **{f"high_fraction_{c}_zero": f"{c}_zero * 10 > n" for c in ("bid_px", "ask_px", "bid_qty", "ask_qty")},
    "px_avg statistical_outlier": "zp > 3", "qty_avg statistical_outlier": "zq > 3", "max_gap_ns statistical_outlier": "zg > 3",
}
TOP_VALUES = ["bid_px", "bid_qty", "ask_px", "ask_qty", "valu"]
TOP_NAMES = ["max_gap", "gaps_100ms", "gaps_1s", "repeated_ts", "non_monotonic_ts", "crossed", "crossed_or_touching", "duplicate_snapshots"]


@query(f"""
WITH t AS (SELECT l_suppkey, epoch_us(l_shipdate) AS us, CAST(round(l_extendedprice * 100) AS BIGINT) AS ask_px, CAST(round(l_quantity * 2000) AS BIGINT) * 130 AS bid_px,
    CAST(l_quantity AS BIGINT) % 8 AS ask_qty, CAST(l_linenumber AS BIGINT) AS bid_qty, NULLIF(CAST(round(l_discount * 100) AS BIGINT), 3) AS valu, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, {LINE_SQL}) AS k FROM lineitem),
w AS (SELECT *, us - lag(us) OVER o AS d, lag(bid_px) OVER o = bid_px AND lag(ask_px) OVER o = ask_px AND lag(bid_qty) OVER o = bid_qty AND lag(ask_qty) OVER o = ask_qty AS same FROM t WINDOW o AS (PARTITION BY l_suppkey ORDER BY k)),
m AS (SELECT l_suppkey, count(*) AS n, max(greatest(d, 0)) AS max_gap, count(*) FILTER (d >= 100000) AS gaps_100ms, count(*) FILTER (d >= 1000000) AS gaps_1s, count(*) FILTER (d = 0) AS repeated_ts,
    count(*) FILTER (d < 0) AS non_monotonic_ts, count(*) FILTER (bid_px > ask_px) AS crossed, count(*) FILTER (bid_px >= ask_px) AS crossed_or_touching, count(*) FILTER (same) AS duplicate_snapshots,
    {", ".join(f"min({c}) AS {c}_min, max({c}) AS {c}_max, avg({c}) AS {c}_avg, count(*) FILTER ({c} = 0) AS {c}_zero, count(*) FILTER ({c} IS NULL) AS {c}_null, round(coalesce(stddev_samp({c}), 0), 1) AS {c}_sd" for c in TOP_VALUES)} FROM w GROUP BY l_suppkey),
z AS (SELECT *, {score_sql("bid_px_avg")} AS zp, {score_sql("bid_qty_avg")} AS zq, {score_sql("max_gap")} AS zg FROM m)
SELECT l_suppkey, n AS "rows", {", ".join(TOP_NAMES)}, {", ".join(f"{c}_{x}" for c in TOP_VALUES for x in ("min", "max", "avg", "zero", "null", "sd"))}, {rules_sql(TOP_RULES)} AS anomalies FROM z""")
def top_audit(spark, sf_dir):  # A2 A9 A10 A11 A12 R2
    discount = cents("l_discount")
    own = table(spark, sf_dir, "lineitem").select(
        *LINE, scalar.micros("l_shipdate").alias("us"), cents("l_extendedprice").alias("ask_px"), (cents("l_quantity", 2000) * 130).alias("bid_px"),
        (F.col("l_quantity").cast("long") % 8).alias("ask_qty"), F.col("l_linenumber").cast("long").alias("bid_qty"), F.when(discount != 3, discount).alias("valu"),
    )
    out = audit.top_audit(own, ["l_suppkey"], ["us", *LINE], F.col("us"), unit=1000, bucket=F.floor(F.col("us") / (90 * DAY_US)))
    measures = [F.round(f"{c}_sd", 1).alias(f"{c}_sd") if x == "sd" else f"{c}_{x}" for c in TOP_VALUES for x in ("min", "max", "avg", "zero", "null", "sd")]
    return out.select("l_suppkey", "rows", *TOP_NAMES, *measures, F.array_join("anomalies", "|").alias("anomalies"))


@query("""
WITH m AS (SELECT user_id, avg(CAST(round(value * 100) AS BIGINT)) AS mean_cents FROM events GROUP BY user_id)
SELECT user_id, mean_cents, round(abs(mean_cents - avg(mean_cents) OVER ()) / stddev_samp(mean_cents) OVER (), 6) AS z, abs(mean_cents - avg(mean_cents) OVER ()) > 2 * stddev_samp(mean_cents) OVER () AS outlier FROM m""")
def zscore_outliers(spark, sf_dir):  # A19
    means = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg(cents("value")).alias("mean_cents"))
    return audit.with_scores(means, ["mean_cents"]).select("user_id", "mean_cents", F.round("z_mean_cents", 6).alias("z"), (F.col("z_mean_cents") > 2).alias("outlier"))


@query("""SELECT l_returnflag, count(*) FILTER (l_discount = 0) AS discount_zero, count(*) FILTER (l_tax = 0) AS tax_zero,
    count(*) FILTER (l_discount = 0) * 10 > count(*) AS many_zero FROM lineitem GROUP BY l_returnflag""")
def zero_fraction(spark, sf_dir):  # A3 R2
    zero = {c: F.count_if(F.col(f"l_{c}") == 0) for c in ("discount", "tax")}
    own = table(spark, sf_dir, "lineitem").groupBy("l_returnflag")
    return own.agg(*(z.alias(f"{c}_zero") for c, z in zero.items()), (zero["discount"] * 10 > F.count("*")).alias("many_zero"))


@query("""
WITH g AS (SELECT l_suppkey, l_orderkey, min(l_partkey) AS f, max(l_partkey) AS l FROM lineitem GROUP BY ALL), w AS (SELECT *, lag(l) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS p FROM g)
SELECT l_suppkey, count(*) FILTER (l < f) AS last_lt_first, count(*) FILTER (f <= p) AS id_overlap, count(*) FILTER (f > p + 1) AS id_gap FROM w GROUP BY l_suppkey""")
def id_overlap_gap(spark, sf_dir):  # A13
    own = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.min("l_partkey").alias("firstId"), F.max("l_partkey").alias("lastId"))
    own = audit.with_id_checks(own, ["l_suppkey"], ["l_orderkey"], bucket=F.floor(F.col("l_orderkey") / 1000))
    return own.groupBy("l_suppkey").agg(*(F.count_if(c).alias(c) for c in ("last_lt_first", "id_overlap", "id_gap")))


def _depth(spark, sf_dir):
    level = F.struct(cents("l_extendedprice").alias("px"), F.col("l_quantity").cast("long").alias("qty"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.when(F.col("l_returnflag") != "R", level))).alias("ask"))


@query("""
SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'R') AS levels, min(CAST(round(l_extendedprice * 100) AS BIGINT)) FILTER (l_returnflag <> 'R') AS px_min,
    max(CAST(round(l_extendedprice * 100) AS BIGINT)) FILTER (l_returnflag <> 'R') AS px_max, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (l_returnflag <> 'R'), 0) AS BIGINT) AS qty_sum,
    count(*) FILTER (l_returnflag <> 'R') = 0 AS empty FROM lineitem GROUP BY l_orderkey""")
def level_stats(spark, sf_dir):  # A14 A17 S5 S6
    qty = F.aggregate("ask", F.lit(0).cast("long"), lambda s, x: s + x["qty"])
    px = F.transform("ask", lambda x: x["px"])
    return _depth(spark, sf_dir).select(
        "l_orderkey", F.size("ask").cast("long").alias("levels"), F.array_min(px).alias("px_min"), F.array_max(px).alias("px_max"), qty.alias("qty_sum"), (F.size("ask") == 0).alias("empty")
    )


@query("""
WITH a AS (SELECT l_orderkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS px, CAST(l_quantity AS BIGINT) AS qty FROM lineitem WHERE l_returnflag <> 'R')
SELECT l_orderkey, string_agg(printf('%.8f(%.8f)', px / 100000000.0, qty / 100000000.0), ',' ORDER BY px, qty) AS levels FROM a GROUP BY l_orderkey""")
def depth_lines(spark, sf_dir):  # K7
    return _depth(spark, sf_dir).where(F.size("ask") > 0).select("l_orderkey", sinks.levels(F.col("ask")).alias("levels"))


@query("""
WITH g AS (SELECT l_partkey % 50 AS symbol, l_suppkey, l_orderkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS px, """ + LINE_SQL.replace("l_orderkey, ", "").replace("l_suppkey, ", "") + """ FROM lineitem),
w AS (SELECT symbol, px, lag(px) OVER (PARTITION BY symbol ORDER BY """ + LINE_SQL + """) AS p FROM g)
SELECT symbol, count(*) FILTER (px > 0 AND p > 0 AND greatest(px, p) > 10 * least(px, p)) AS jumps FROM w GROUP BY symbol""")
def price_jump_10x(spark, sf_dir):  # A15
    own = table(spark, sf_dir, "lineitem").withColumns({"symbol": F.col("l_partkey") % 50, "px": cents("l_extendedprice")})
    own = rows.lagged(own.select("symbol", "px", *LINE), ["symbol"], LINE, {"before": ("px", 1)}, F.floor(F.col("l_orderkey") / 1000))
    return own.withColumn("jump", audit.jump(F.col("px"), F.col("before"))).groupBy("symbol").agg(F.count_if("jump").alias("jumps"))


@query("""SELECT l_linestatus, count(*) FILTER (CAST(round(l_extendedprice * 100) AS BIGINT) % 1000 <> 0) AS px_odd, count(*) FILTER (CAST(l_quantity AS BIGINT) % 5 <> 0) AS qty_odd FROM lineitem GROUP BY l_linestatus""")
def divisibility(spark, sf_dir):  # A16
    own = table(spark, sf_dir, "lineitem").groupBy("l_linestatus")
    return own.agg(F.count_if(F.pmod(cents("l_extendedprice"), F.lit(1000)) != 0).alias("px_odd"), F.count_if(F.pmod(F.col("l_quantity").cast("long"), F.lit(5)) != 0).alias("qty_odd"))


@query("""
SELECT event_id, event_type, CAST(s AS BIGINT) AS rolling_sum FROM (SELECT event_id, event_type, CAST(round(value * 100) AS BIGINT) AS v, sum(CAST(round(value * 100) AS BIGINT)) OVER w AS s, count(*) OVER w AS n
    FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS 9 PRECEDING)) WHERE n = 10 AND v * 10 > s * 2""")
def rolling_spike(spark, sf_dir):  # W3
    return rows.spikes(table(spark, sf_dir, "events"), ["event_type"], ["ts", "event_id"], cents("value"), bucket=day("ts")).select("event_id", "event_type", "rolling_sum")


@query("""
SELECT user_id, count(*) FILTER (n > 0 AND v * n > s) AS above FROM (SELECT user_id, CAST(round(value * 100) AS BIGINT) AS v, sum(CAST(round(value * 100) AS BIGINT)) OVER w AS s, count(*) OVER w AS n
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) GROUP BY user_id""")
def expanding_mean_count(spark, sf_dir):  # W4
    return rows.above_mean_so_far(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], cents("value"), day("ts"))


@query("""SELECT event_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS DOUBLE) / count(*) OVER w AS running_mean FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_average(spark, sf_dir):  # W15
    return rows.running_mean(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], cents("value"), bucket=day("ts")).select("event_id", "running_mean")


@query("""
WITH r AS (SELECT user_id, epoch_us(ts) AS us, CAST(round(value * 100) AS BIGINT) AS v FROM events)
SELECT user_id, min(v) AS min_v, max(v) AS max_v, min(us) FILTER (v = lo) AS min_v_ts, min(us) FILTER (v = hi) AS max_v_ts
FROM (SELECT *, min(v) OVER (PARTITION BY user_id) AS lo, max(v) OVER (PARTITION BY user_id) AS hi FROM r) GROUP BY user_id""")
def sampled_extremes(spark, sf_dir):  # S7
    own = events(spark, sf_dir).withColumn("v", cents("value"))
    return rows.extremes(own, ["user_id"], "us", ["v"])


def _streams(spark, sf_dir, columns):
    own = events(spark, sf_dir)
    return {n: own.where(F.col("event_type") == t).select(*columns) for n, t in (("b", "click"), ("x", "view"), ("z", "purchase"))}


STREAMS_SQL = "".join(
    f"{'WITH' if n == 'b' else ','} {n} AS (SELECT event_id, epoch_us(ts) AS us, value, CAST(row_number() OVER (ORDER BY ts, event_id) AS BIGINT) AS nth FROM events WHERE event_type = '{t}')"
    for n, t in (("b", "click"), ("x", "view"), ("z", "purchase"))
)


@query(STREAMS_SQL + " SELECT nth, b.event_id AS b_event_id, x.event_id AS x_event_id, z.event_id AS z_event_id FROM b JOIN x USING (nth) JOIN z USING (nth)")
def zip_join(spark, sf_dir):  # J1
    return align.zipped(_streams(spark, sf_dir, ["event_id", "us"]), ["us", "event_id"], F.floor(F.col("us") / 86_400_000_000)).select("nth", "b_event_id", "x_event_id", "z_event_id")


@query(STREAMS_SQL + " SELECT nth, CAST(b.us // 86400000000 AS BIGINT) AS day FROM b JOIN x USING (nth) JOIN z USING (nth) WHERE b.us // 86400000000 = x.us // 86400000000 AND b.us // 86400000000 = z.us // 86400000000")
def zip_equal_times(spark, sf_dir):  # J3
    streams = {n: df.select("event_id", "us", F.floor(F.col("us") / 86_400_000_000).alias("day")) for n, df in _streams(spark, sf_dir, ["event_id", "us"]).items()}
    return align.zipped(streams, ["us", "event_id"], F.col("day"), same="day").select("nth", F.col("b_day").alias("day"))


@query("""
WITH e AS (SELECT event_type, CAST(epoch_us(ts) // 3600000000 AS BIGINT) AS hour, event_id, row_number() OVER (PARTITION BY event_type, epoch_us(ts) // 3600000000 ORDER BY event_id DESC) AS r FROM events), l AS (SELECT * FROM e WHERE r = 1)
SELECT b.hour, b.event_id AS b_event_id, x.event_id AS x_event_id, z.event_id AS z_event_id FROM l b JOIN l x ON b.hour = x.hour JOIN l z ON b.hour = z.hour
WHERE b.event_type = 'click' AND x.event_type = 'view' AND z.event_type = 'purchase'""")
def equi_join_ts(spark, sf_dir):  # J2
    streams = {n: df.select(F.floor(F.col("us") / 3_600_000_000).alias("hour"), "event_id") for n, df in _streams(spark, sf_dir, ["event_id", "us"]).items()}
    return align.equal_times(streams, "hour", ["event_id"])


ASOF_SQL = """
WITH e AS (SELECT epoch_us(ts) AS us, event_id, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS stream, value FROM events WHERE event_type IN ('click', 'view', 'purchase')),
f AS (SELECT us, stream, event_id, """ + ", ".join(
    f"last_value(CASE WHEN stream = {k} THEN {c} END IGNORE NULLS) OVER w AS {n}_{c}" for k, n in enumerate("bxz") for c in ("us", "value")
) + " FROM e WINDOW w AS (ORDER BY us, stream, event_id ROWS UNBOUNDED PRECEDING)) "


@query(ASOF_SQL + "SELECT us AS ts, event_id AS tie, b_value, x_value, z_value FROM f WHERE b_us IS NOT NULL AND x_us IS NOT NULL AND z_us IS NOT NULL")
def asof_ffill(spark, sf_dir):  # J4 J5 W5
    out = align.as_of(_streams(spark, sf_dir, ["event_id", "us", "value"]), "us", "event_id", ["value"], bucket=F.floor(F.col("ts") / 86_400_000_000))
    return out.select("ts", "tie", "b_value", "x_value", "z_value")


@query(ASOF_SQL + "SELECT event_id AS tie, (us - b_us) / 1000.0 AS b_lag_ms, (us - x_us) / 1000.0 AS x_lag_ms, (us - z_us) / 1000.0 AS z_lag_ms FROM f WHERE b_us IS NOT NULL AND x_us IS NOT NULL AND z_us IS NOT NULL")
def leg_lags(spark, sf_dir):  # J6
    out = align.as_of(_streams(spark, sf_dir, ["event_id", "us", "value"]), "us", "event_id", ["value"], bucket=F.floor(F.col("ts") / 86_400_000_000))
    return out.select("tie", *((F.col(f"{s}_lag") / 1000.0).alias(f"{s}_lag_ms") for s in "bxz"))


LEGS_SQL = ASOF_SQL + """, l AS (SELECT event_id AS tie, b_value + 1.0 AS b_bid_px, b_value + 1.5 AS b_ask_px, (x_value + 1.0) / 100.0 AS x_bid_px, (x_value + 1.5) / 100.0 AS x_ask_px,
    z_value + 1.0 AS z_bid_px, z_value + 1.5 AS z_ask_px, 2.0 AS b_bid_qty, 3.0 AS b_ask_qty, 5.0 AS x_bid_qty, 7.0 AS x_ask_qty, 11.0 AS z_bid_qty, 13.0 AS z_ask_qty FROM f WHERE b_us IS NOT NULL AND x_us IS NOT NULL AND z_us IS NOT NULL),
c AS (SELECT *, least(100.0, b_ask_qty * b_ask_px, x_ask_qty * x_ask_px * b_ask_px, z_bid_qty * z_bid_px) AS capital_direct, least(100.0, z_ask_qty * z_ask_px, x_bid_qty * x_bid_px * b_ask_px) AS capital_reverse FROM l),
p AS (SELECT *, capital_direct / b_ask_px * (1 - 0.00075e0) / x_ask_px * (1 - 0.00075e0) * z_bid_px * (1 - 0.00075e0) - capital_direct AS profit_direct,
    capital_reverse / z_ask_px * (1 - 0.00075e0) * x_bid_px * (1 - 0.00075e0) * b_bid_px * (1 - 0.00075e0) - capital_reverse AS profit_reverse FROM c) """


def _legs(spark, sf_dir):
    out = align.as_of(_streams(spark, sf_dir, ["event_id", "us", "value"]), "us", "event_id", ["value"], bucket=F.floor(F.col("ts") / 86_400_000_000))
    qty = {"b_bid_qty": 2.0, "b_ask_qty": 3.0, "x_bid_qty": 5.0, "x_ask_qty": 7.0, "z_bid_qty": 11.0, "z_ask_qty": 13.0}
    px = {f"{s}_{side}_px": (F.col(f"{s}_value") + add) / (100.0 if s == "x" else 1.0) for s in "bxz" for side, add in (("bid", 1.0), ("ask", 1.5))}
    return out.select("tie", *(c.alias(n) for n, c in px.items()), *(F.lit(v).alias(n) for n, v in qty.items()))


@query(LEGS_SQL + "SELECT tie, round(profit_direct, 4) AS profit_direct, round(profit_reverse, 4) AS profit_reverse FROM p WHERE profit_direct > 0 OR profit_reverse > 0")
def tri_profit(spark, sf_dir):  # C6 C7 C8 F11
    out = arbitrage.profitable(arbitrage.profits(_legs(spark, sf_dir)))
    return out.select("tie", F.round("profit_direct", 4).alias("profit_direct"), F.round("profit_reverse", 4).alias("profit_reverse"))


@query(LEGS_SQL + """SELECT tie, round(capital_direct, 6) AS capital_direct, CASE WHEN capital_direct >= 100 THEN '-' WHEN capital_direct = b_ask_qty * b_ask_px THEN 'BTC ask vol'
    WHEN capital_direct = x_ask_qty * x_ask_px * b_ask_px THEN 'XTZ ask vol' ELSE 'XTZ/USDT bid vol' END AS limit_direct, round(capital_reverse, 6) AS capital_reverse,
    CASE WHEN capital_reverse >= 100 THEN '-' WHEN capital_reverse = z_ask_qty * z_ask_px THEN 'XTZ ask vol' ELSE 'BTC bid vol' END AS limit_reverse FROM p""")
def tri_limits(spark, sf_dir):  # C9
    out = arbitrage.profits(_legs(spark, sf_dir))
    return out.select("tie", F.round("capital_direct", 6).alias("capital_direct"), "limit_direct", F.round("capital_reverse", 6).alias("capital_reverse"), "limit_reverse")


@query(LEGS_SQL + """SELECT 'positive side' AS mode, round(sum(CASE WHEN profit_direct > 0 THEN profit_direct ELSE 0 END), 2) AS total_direct, round(sum(CASE WHEN profit_reverse > 0 THEN profit_reverse ELSE 0 END), 2) AS total_reverse FROM p
    UNION ALL SELECT 'either side', round(sum(profit_direct), 2), round(sum(profit_reverse), 2) FROM p WHERE profit_direct > 0 OR profit_reverse > 0""")
def tri_totals(spark, sf_dir):  # A20
    out = arbitrage.profits(_legs(spark, sf_dir))
    return arbitrage.totals(out).select("mode", *(F.round(f"total_{s}", 2).alias(f"total_{s}") for s in ("direct", "reverse")))


@query(LEGS_SQL + "SELECT tie, round(greatest(profit_direct, profit_reverse), 4) AS profit FROM p ORDER BY greatest(profit_direct, profit_reverse) DESC, tie LIMIT 20")
def top_profit(spark, sf_dir):  # O7
    out = arbitrage.best(arbitrage.profits(_legs(spark, sf_dir)), 20, "tie")
    return out.select("tie", F.round(F.greatest("profit_direct", "profit_reverse"), 4).alias("profit"))


@query(LEGS_SQL + """, t AS (SELECT * FROM p ORDER BY greatest(profit_direct, profit_reverse) DESC, tie LIMIT 5)
SELECT 'total' AS name, round(sum(greatest(profit_direct, profit_reverse)), 4) AS profit FROM t UNION ALL SELECT CAST(tie AS VARCHAR), round(greatest(profit_direct, profit_reverse), 4) FROM t""")
def result_with_total(spark, sf_dir):  # K10
    top = arbitrage.best(arbitrage.profits(_legs(spark, sf_dir)), 5, "tie").select(F.col("tie").cast("string").alias("name"), F.greatest("profit_direct", "profit_reverse").alias("profit"))
    out = sinks.with_total(top, top.agg(F.lit("total").alias("name"), F.sum("profit").alias("profit")).select("name", "profit"), "profit")
    return out.select("name", F.round("profit", 4).alias("profit"))


#: Segments of events of a user that are at most two days apart, of values over two.
SERIES_SQL = """
WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us, value, value > 2 AS ok FROM events),
s AS (SELECT *, lag(us) OVER o IS NULL OR us - lag(us) OVER o <= 0 OR us - lag(us) OVER o > 172800000000 OR NOT ok OR NOT lag(ok) OVER o AS starts FROM e WINDOW o AS (PARTITION BY user_id ORDER BY us, event_id)),
g AS (SELECT *, CAST(sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS BIGINT) AS segment FROM s),
y AS (SELECT *, ln(value + 1) - ln(lag(value + 1) OVER (PARTITION BY user_id, segment ORDER BY us, event_id)) AS y FROM g WHERE ok), r AS (SELECT * FROM y WHERE y IS NOT NULL)
"""


def _series(spark, sf_dir):
    own = rows.segments(events(spark, sf_dir), ["user_id"], ["us", "event_id"], F.col("us"), 172_800_000_000, F.col("value") > 2, us_day())
    return arma.returns(own, ["user_id"], ["us", "event_id"], F.col("value") + 1, bucket=us_day())


@query(SERIES_SQL + "SELECT user_id, event_id, segment, round(y, 8) AS y FROM r")
def returns_segments(spark, sf_dir):  # F10 W6 W7
    return _series(spark, sf_dir).select("user_id", "event_id", F.col("segment").cast("long").alias("segment"), F.round("y", 8).alias("y"))


@query(SERIES_SQL + """, l AS (SELECT *, lag(y) OVER (PARTITION BY user_id, segment ORDER BY us, event_id) AS x FROM r), k AS (SELECT *, pow(0.5e0, (1.0e0 / 50)) AS lam, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) - 1 AS age FROM l WHERE x IS NOT NULL),
m AS (SELECT user_id, count(*) AS used, sum(pow(lam, age) * x * x) + 0.001 AS a, sum(pow(lam, age) * x) AS b, sum(pow(lam, age)) + 0.001 AS d, sum(pow(lam, age) * x * y) AS u, sum(pow(lam, age) * y) AS v FROM k GROUP BY user_id)
SELECT user_id, used, round((u * d - b * v) / (a * d - b * b), 6) AS phi1, round((a * v - b * u) / (a * d - b * b), 6) AS intercept FROM m WHERE used >= 20""")
def ew_ar_fit(spark, sf_dir):  # W8 W9 M1 M3 K11
    own = arma.lagged(_series(spark, sf_dir), ["user_id"], ["us", "event_id"], 1, us_day())
    out = arma.solve_ar(arma.moments(own, ["user_id"], ["us", "event_id"], 1, 50, us_day()), ["user_id"], 1, 0.001).where("used >= 20")
    return out.select("user_id", "used", F.round(F.col("theta")[0], 6).alias("phi1"), F.round(F.col("theta")[1], 6).alias("intercept"))


@query(SERIES_SQL + """, t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) > count(*) OVER (PARTITION BY user_id) - CAST(floor(count(*) OVER (PARTITION BY user_id) * 0.3) AS BIGINT) AS test,
    -0.5 * lag(y) OVER (PARTITION BY user_id, segment ORDER BY us, event_id) AS z FROM r), o AS (SELECT * FROM t WHERE test AND z IS NOT NULL)
SELECT user_id, count(*) AS n, round(sqrt(sum((y - z) * (y - z)) / count(*)), 6) AS rmse, round(sum(abs(y - z)) / count(*), 6) AS mae, round(1 - sum((y - z) * (y - z)) / (var_pop(y) * count(*)), 4) AS r2,
    round(sum(y * z) / sqrt(sum(z * z) * sum(y * y)), 6) AS corr FROM o GROUP BY user_id HAVING count(*) >= 5""")
def oos_metrics(spark, sf_dir):  # A29 M6
    own = arma.split(_series(spark, sf_dir), ["user_id"], ["us", "event_id"], 0.3, us_day())
    own = arma.rows_before(own, ["user_id"], ["us", "event_id"], "y", 1, us_day())
    own = own.withColumn("z", -0.5 * F.col("__y1")).where("test AND z IS NOT NULL")
    out = arma.errors(own, ["user_id"], "y", "z").where("n >= 5")
    return out.select("user_id", "n", F.round("rmse", 6).alias("rmse"), F.round("mae", 6).alias("mae"), F.round("r2", 4).alias("r2"), F.round("corr", 6).alias("corr"))


@query(SERIES_SQL + """, d AS (SELECT user_id, us, event_id, segment, y - avg(y) OVER (PARTITION BY user_id) AS d, count(*) OVER (PARTITION BY user_id) AS n FROM r),
l AS (SELECT *, lag(d) OVER w AS d1, lag(d, 2) OVER w AS d2 FROM d WINDOW w AS (PARTITION BY user_id, segment ORDER BY us, event_id)),
q AS (SELECT user_id, n, sum(d * d1) / sum(d * d) AS r1, sum(d * d2) / sum(d * d) AS r2 FROM l GROUP BY user_id, n HAVING n >= 10)
SELECT user_id, n, round(r1, 6) AS rho_1, round(r2, 6) AS rho_2, round(n * (n + 2) * (coalesce(r1 * r1, 0) / (n - 1) + coalesce(r2 * r2, 0) / (n - 2)), 4) AS q FROM q""")
def autocorr(spark, sf_dir):  # M4
    out = arma.autocorrelations(_series(spark, sf_dir), ["user_id"], ["us", "event_id"], "y", 2, us_day()).where("n >= 10")
    return out.select("user_id", "n", F.round("rho_1", 6).alias("rho_1"), F.round("rho_2", 6).alias("rho_2"), F.round("q", 4).alias("q"))


#: The online fit of one lag and one error, a row a turn: sums, then the 3 x 3 system by Cramer's rule, then the next state.
ARMA_SQL = SERIES_SQL.replace("WITH e AS", "WITH RECURSIVE e AS") + """, i AS (SELECT user_id, y, row_number() OVER (PARTITION BY user_id, segment ORDER BY us, event_id) = 1 AS starts, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS k FROM r),
h AS (SELECT DISTINCT user_id, hl, pow(0.5e0, 1.0e0 / hl) AS lam FROM i, (VALUES (25.0e0), (100.0e0)) v(hl)),
z AS (SELECT user_id, hl, lam, CAST(0 AS BIGINT) AS k, CAST(NULL AS DOUBLE) AS lag, 0.0e0 AS err, CAST(0 AS BIGINT) AS used, 0.0e0 AS a, 0.0e0 AS b, 0.0e0 AS c, 0.0e0 AS d, 0.0e0 AS e, 0.0e0 AS f, 0.0e0 AS u, 0.0e0 AS v, 0.0e0 AS w,
    CAST(NULL AS DOUBLE) AS t1, CAST(NULL AS DOUBLE) AS t2, CAST(NULL AS DOUBLE) AS t3, 0.0e0 AS var FROM h
  UNION ALL SELECT user_id, hl, lam, k, y, CASE WHEN fits THEN y - coalesce(x * o1 + z * o2 + o3, 0) ELSE z END, used + fits::INT, a, b, c, d, e, f, u, v, w, t1, t2, t3,
    CASE WHEN NOT fits THEN var WHEN var = 0 THEN (y - x * t1 - z * t2 - t3) ** 2 ELSE lam * var + (1 - lam) * (y - x * t1 - z * t2 - t3) ** 2 END
  FROM (SELECT *, CASE WHEN fits THEN (u * (q * r - e * e) - b * (v * r - e * w) + c * (v * e - q * w)) / det ELSE o1 END AS t1, CASE WHEN fits THEN (g * (v * r - e * w) - u * (b * r - c * e) + c * (b * w - c * v)) / det ELSE o2 END AS t2,
      CASE WHEN fits THEN (g * (q * w - e * v) - b * (b * w - c * v) + u * (b * e - c * q)) / det ELSE o3 END AS t3
    FROM (SELECT *, g * (q * r - e * e) - b * (b * r - c * e) + c * (b * e - c * q) AS det
      FROM (SELECT *, a + 0.001 AS g, d + 0.001 AS q, f + 0.001 AS r
        FROM (SELECT user_id, hl, lam, k, y, x, z, fits, used, var, o1, o2, o3, CASE WHEN fits THEN lam * a + x * x ELSE a END AS a, CASE WHEN fits THEN lam * b + x * z ELSE b END AS b, CASE WHEN fits THEN lam * c + x ELSE c END AS c,
            CASE WHEN fits THEN lam * d + z * z ELSE d END AS d, CASE WHEN fits THEN lam * e + z ELSE e END AS e, CASE WHEN fits THEN lam * f + 1 ELSE f END AS f, CASE WHEN fits THEN lam * u + x * y ELSE u END AS u,
            CASE WHEN fits THEN lam * v + z * y ELSE v END AS v, CASE WHEN fits THEN lam * w + y ELSE w END AS w
          FROM (SELECT z.* EXCLUDE (k, lag, err, t1, t2, t3), t1 AS o1, t2 AS o2, t3 AS o3, i.k, i.y, CASE WHEN i.starts THEN NULL ELSE z.lag END AS x, CASE WHEN i.starts THEN 0 ELSE z.err END AS z, NOT i.starts AND z.lag IS NOT NULL AS fits
            FROM z JOIN i ON i.user_id = z.user_id AND i.k = z.k + 1))))))
SELECT user_id, hl, used, round(t1, 5) AS phi, round(t2, 5) AS psi, round(t3, 5) AS intercept, round(abs(t1), 5) AS rho_ar, round(abs(t2), 5) AS rho_ma, round(sqrt(var), 5) AS sigma
FROM z QUALIFY row_number() OVER (PARTITION BY user_id, hl ORDER BY k DESC) = 1 AND used >= 10"""


@query(ARMA_SQL)
def arma_fit(spark, sf_dir):  # M2 M3 W10
    out = arma.fit_arma(_series(spark, sf_dir), ["user_id"], ["us", "event_id"], 1, 1, [25.0, 100.0], 1e-3).where("used >= 10")
    theta = (F.round(F.col("theta")[k], 5).alias(n) for k, n in enumerate(("phi", "psi", "intercept")))
    return out.select("user_id", "hl", "used", *theta, *(F.round(c, 5).alias(c) for c in ("rho_ar", "rho_ma", "sigma")))


@query(SERIES_SQL + """, d AS (SELECT event_id, y / 10 AS a, y / 20 AS b FROM r), m AS (SELECT *, exp(a) - 1 AS ra, exp(b) - 1 AS rb FROM d), x AS (SELECT *, CASE WHEN ra > 0 THEN least(ra, rb) ELSE greatest(ra, rb) END AS e FROM m)
SELECT event_id, CAST(CASE WHEN k THEN CASE WHEN e > 0 THEN 1 ELSE -1 END ELSE 0 END AS INTEGER) AS side, round(CASE WHEN k THEN abs(greatest(-1.0, least(1.0, 0.5 * e / 0.05))) ELSE 0 END, 6) AS size, CAST(CASE WHEN k THEN 1 ELSE 0 END AS INTEGER) AS hold_bars
FROM (SELECT *, abs(ra) >= 0.0002 AND abs(rb) >= 0.0002 AND abs(e) > 0.00095 AS k FROM x)""")
def trade_decisions(spark, sf_dir):  # C10 M7
    c = F.lit
    own = _series(spark, sf_dir).select("event_id", arma.decision(F.col("y") / 10, F.col("y") / 20, c(0.05), c(0.5), c(0.4), c(6.0), c(9.0), c(1.0)).alias("d"))
    return own.select("event_id", "d.side", F.round("d.size", 6).alias("size"), "d.hold_bars")


MIXED = "CASE WHEN p_size % 3 = 0 THEN p_brand WHEN p_size % 3 = 1 THEN CAST(p_size AS {t}) ELSE CAST(p_partkey AS {t}) END"


@query("WITH m AS (SELECT p_partkey, " + MIXED.format(t="VARCHAR") + " AS k FROM part) SELECT p_partkey, k, CAST(row_number() OVER (ORDER BY try_cast(k AS DOUBLE) IS NULL, try_cast(k AS DOUBLE), k, p_partkey) AS BIGINT) AS nth FROM m")
def sort_numeric_then_text(spark, sf_dir):  # O1 O2 S14
    own = table(spark, sf_dir, "part").select("p_partkey", F.expr(MIXED.format(t="STRING")).alias("k"))
    number = F.col("k").try_cast("double")
    own = own.withColumns({"text": number.isNull(), "number": F.coalesce(number, F.lit(0.0))})
    # texts go by their first character, numbers by a coarse value: buckets that don't decrease in the order
    bucket = F.when(F.col("text"), F.lit(1e12) + F.ascii("k")).otherwise(F.floor(F.col("number") / 500))
    return rows.numbered(own, ["text", "number", "k", "p_partkey"], bucket).select("p_partkey", "k", "nth")


@query("""
WITH m AS (SELECT 0 AS src, event_id, epoch_us(ts) AS us FROM events WHERE event_type = 'click' UNION ALL SELECT 1, event_id, epoch_us(ts) FROM events WHERE event_type = 'view' UNION ALL SELECT 2, event_id, epoch_us(ts) FROM events WHERE event_type = 'error')
SELECT CAST(src AS INTEGER) AS src, event_id, CAST(row_number() OVER (ORDER BY us, src, event_id) AS BIGINT) AS nth FROM m""")
def kway_merge(spark, sf_dir):  # O3 O4 O5 O6 U1
    own = events(spark, sf_dir)
    out = sorting.merged([own.where(F.col("event_type") == t).select("event_id", "us") for t in ("click", "view", "error")], "us")
    return rows.numbered(out, ["us", "src", "event_id"], F.floor(F.col("us") / 86_400_000_000)).select("src", "event_id", "nth")


@query("SELECT p_partkey, p_name, CAST(row_number() OVER (ORDER BY length(p_name), p_name, p_partkey) AS BIGINT) AS nth FROM part")
def length_then_text(spark, sf_dir):  # O8
    return rows.numbered(table(spark, sf_dir, "part"), [F.length("p_name"), "p_name", "p_partkey"], F.length("p_name")).select("p_partkey", "p_name", "nth")


@query("SELECT l_orderkey, l_linenumber, l_partkey, list_sort([l_orderkey, l_partkey, l_suppkey])[1] AS low, list_sort([l_orderkey, l_partkey, l_suppkey])[2] AS middle, list_sort([l_orderkey, l_partkey, l_suppkey])[3] AS high FROM lineitem")
def sort_three(spark, sf_dir):  # O9
    own = table(spark, sf_dir, "lineitem").withColumn("s", sorting.sorted_values("l_orderkey", "l_partkey", "l_suppkey"))
    return own.select("l_orderkey", "l_linenumber", "l_partkey", *(F.col("s")[k].alias(n) for k, n in enumerate(("low", "middle", "high"))))


@query("""SELECT a.r_name || ',' || b.r_name || ',' || c.r_name AS p FROM region a, region b, region c WHERE a.r_name <> b.r_name AND a.r_name <> c.r_name AND b.r_name <> c.r_name""")
def permutations(spark, sf_dir):  # O10 J9
    return sorting.permutations(table(spark, sf_dir, "region"), "r_name", 3).select(F.array_join("p", ",").alias("p"))


@query("WITH c AS (SELECT p_size, count(*) AS n FROM part GROUP BY p_size) SELECT p_size, n FROM c WHERE n = (SELECT max(n) FROM c)")
def mode_with_ties(spark, sf_dir):  # A22
    return aggregates.modes(table(spark, sf_dir, "part"), "p_size")


@query("""
WITH w AS (SELECT *, CASE WHEN lag(event_type) OVER o = event_type THEN 0 ELSE 1 END AS f FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, CAST(sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS run FROM w)
SELECT user_id, run, event_type, count(*) AS units, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS revenue, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*) AS average FROM g GROUP BY ALL""")
def adjacent_groups(spark, sf_dir):  # A21
    own = table(spark, sf_dir, "events").withColumns({"unit": F.lit(1).cast("long"), "cents": cents("value")})
    return aggregates.adjacent_groups(own, ["user_id"], ["ts", "event_id"], "event_type", aggregates.sales("unit", "cents"), day("ts"))


@query("""SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(l_quantity AS BIGINT)) AS DOUBLE) / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS vwap_cents FROM lineitem GROUP BY l_orderkey""")
def vwap(spark, sf_dir):  # A27
    qty = F.col("l_quantity").cast("long")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(qty).alias("qty"), (F.sum(cents("l_extendedprice") * qty).cast("double") / F.sum(qty).cast("double")).alias("vwap_cents"))


@query("""
WITH s AS (SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT) * l_linenumber) AS DOUBLE) AS subtotal FROM lineitem GROUP BY l_orderkey), d AS (SELECT *, CASE WHEN subtotal >= 100 THEN subtotal * 0.1e0 ELSE 0 END AS discount FROM s)
SELECT l_orderkey, subtotal, round(discount, 6) AS discount, round((subtotal - discount) * 0.07e0, 6) AS tax, round(subtotal - discount + (subtotal - discount) * 0.07e0, 6) AS total FROM d""")
def receipt_total(spark, sf_dir):  # A24
    out = aggregates.receipt(table(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_linenumber").cast("long"), F.col("l_quantity").cast("long"))
    return out.select("l_orderkey", F.col("subtotal").cast("double").alias("subtotal"), *(F.round(c, 6).alias(c) for c in ("discount", "tax", "total")))


@query("""SELECT c_custkey, CAST(round(c_acctbal * 1000) AS BIGINT) AS income, t.total, CAST(round(c_acctbal * 1000) AS BIGINT) - t.total AS savings, t.total > CAST(round(c_acctbal * 1000) AS BIGINT) AS exceeds
    FROM customer JOIN (SELECT o_custkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS total FROM orders GROUP BY o_custkey) t ON o_custkey = c_custkey""")
def budget(spark, sf_dir):  # A23
    spent = table(spark, sf_dir, "orders").select("o_custkey", cents("o_totalprice").alias("amount"))
    own = spent.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), cents("c_acctbal", 1000).alias("inc")), "o_custkey")
    return aggregates.budget(own.withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"], F.col("inc"), "amount")


@query("SELECT l_returnflag, sum(CAST(l_quantity AS BIGINT)) FILTER (l_linestatus = 'F')::BIGINT AS \"F\", sum(CAST(l_quantity AS BIGINT)) FILTER (l_linestatus = 'O')::BIGINT AS \"O\" FROM lineitem GROUP BY l_returnflag")
def pivot_sales(spark, sf_dir):  # A28
    return aggregates.table_of(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"], F.sum(F.col("l_quantity").cast("long")))


@query("SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total FROM lineitem GROUP BY l_returnflag")
def parallel_sum(spark, sf_dir):  # A26
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("total"))


@query("SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), -1) AS k, (coalesce(CAST(json_extract(props, '$.k') AS BIGINT), -1) + 3) // 4 AS vsize, CAST(-1 AS BIGINT) AS missing FROM events")
def json_field(spark, sf_dir):  # S15 C18
    own = table(spark, sf_dir, "events").withColumn("k", files.json_field("props", "$.k", "long", -1))
    return own.select("event_id", "k", F.expr("(k + 3) div 4").alias("vsize"), files.json_field("props", "$.nothing", "long", -1).alias("missing"))


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
def tail_n(spark, sf_dir):  # W12
    return rows.tail(table(spark, sf_dir, "events"), 25, [F.col("ts"), F.col("event_id")]).select("event_id", "ts")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS value, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents)
SELECT doc_id, CAST(line AS INTEGER) AS line, value FROM l WHERE contains(value, 'License')""")
def keyword_search(spark, sf_dir):  # F12
    own = table(spark, sf_dir, "documents").where(F.col("text").contains("License")).select("doc_id", F.explode(sorting.lines_of(F.col("text"))).alias("l"))
    return sorting.search(own.select("doc_id", F.col("l.line").cast("int").alias("line"), "l.value"), "License")


@query("SELECT doc_id, length(text) - length(replace(text, ' ', '')) + 1 AS words, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters, length(text) AS chars FROM documents")
def word_counts(spark, sf_dir):  # A25
    counts = aggregates.text_counts(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", *(c.cast("long").alias(n) for n, c in counts.items()))


@query("""SELECT o_orderkey, CAST(bit_count(o_orderkey) AS INTEGER) AS ones, o_orderkey > 0 AND (o_orderkey & (o_orderkey - 1)) = 0 AS power, reverse(right(lpad(bin(o_orderkey), 64, '0'), 32)) AS reversed,
    (((o_orderkey & 255) << 8) | (o_custkey & 255)) AS joined, (o_orderkey & ~255) | (o_custkey & 255) AS replaced FROM orders""")
def bits(spark, sf_dir):  # C11 C12 C13 C14
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.bit_count(o).alias("ones"), scalar.power_of_two(o).alias("power"), scalar.bits_reversed(o, 32).alias("reversed"),
        scalar.bytes_joined(o, c).alias("joined"), scalar.byte_replaced(o, 0, c).alias("replaced"),
    )


@query("""SELECT o_orderkey, (o_orderkey + o_custkey) & 65535 AS added, (o_orderkey - o_custkey) & 65535 AS subtracted, xor(o_orderkey, o_custkey) & 65535 AS xored, ((o_orderkey + o_custkey) & 65535) = 0 AS zero,
    ((o_orderkey & 65535) + (o_custkey & 65535)) > 65535 AS carry, lower(printf('%02x', o_orderkey & 255) || printf('%02x', (o_orderkey >> 8) & 255)) AS low_bytes FROM orders""")
def alu(spark, sf_dir):  # C20 C14
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    zero, _, carry, _ = scalar.alu_flags(o, c)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", scalar.alu("add", o, c).alias("added"), scalar.alu("sub", o, c).alias("subtracted"), scalar.alu("xor", o, c).alias("xored"), zero.alias("zero"), carry.alias("carry"),
        scalar.little_endian_hex(o, 2).alias("low_bytes"),
    )


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber * l_suppkey + l_partkey * 7 AS num, l_suppkey * 7 + 0 AS unused, CAST(floor(l_extendedprice / 37) AS BIGINT) AS units, l_orderkey % 2 = 0 AS even FROM lineitem""")
def fractions_units(spark, sf_dir):  # C15 C16
    n, _ = scalar.fraction("add", F.col("l_linenumber"), F.lit(7), F.col("l_partkey"), F.col("l_suppkey"))
    own = table(spark, sf_dir, "lineitem")
    return own.select("l_orderkey", "l_linenumber", "l_partkey", n.alias("num"), (F.col("l_suppkey") * 7).alias("unused"), F.floor(F.col("l_extendedprice") / 37).alias("units"), (F.pmod("l_orderkey", F.lit(2)) == 0).alias("even"))


@query("""
WITH o AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, CAST(round(value * 100) AS BIGINT) AS px FROM events), t AS (SELECT *, CASE WHEN side = 'BUY' THEN px >= 2500 ELSE px <= 2400 END AS taker, CASE WHEN side = 'BUY' THEN px < 2500 ELSE px > 2400 END AS may_post FROM o)
SELECT event_id, side, taker, round(px * 3 * CASE WHEN taker THEN 0.0004e0 ELSE 0.0001e0 END, 6) AS fee, may_post FROM t""")
def maker_taker(spark, sf_dir):  # F13 F14 C19
    own = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, "BUY").otherwise("SELL").alias("side"), cents("value").alias("px"))
    bid, ask = F.lit(2400), F.lit(2500)
    own = own.withColumn("taker", scalar.taker(F.col("side"), F.col("px"), bid, ask))
    return own.select("event_id", "side", "taker", F.round(scalar.fee(F.col("px"), F.lit(3), F.col("taker")), 6).alias("fee"), scalar.may_post(F.col("side"), F.col("px"), bid, ask, F.lit(0)).alias("may_post"))


@query("""
WITH c AS (SELECT *, round(l_extendedprice * 100) * l_quantity AS cost FROM lineitem), w AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY l_suppkey ORDER BY """ + LINE_SQL + """ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM c)
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, least(cost, 2000000000 - spent) AS cost, round(least(cost, 2000000000 - spent) / round(l_extendedprice * 100), 6) AS bought FROM w WHERE spent < 2000000000""")
def book_walk(spark, sf_dir):  # W11
    out = rows.book_walk(table(spark, sf_dir, "lineitem"), ["l_suppkey"], LINE, F.round(F.col("l_extendedprice") * 100), F.col("l_quantity"), 2e9, 0.0)
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "cost", F.round("bought", 6).alias("bought"))


@query("""
WITH l AS (SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS mid, unnest(range(0, 10)) AS level FROM part)
SELECT p_partkey, CAST(level AS INTEGER) AS level, mid - (level + 1) * 500 AS price FROM l WHERE 2.0 * ((level + 1) * mid - 500.0 * (level + 1) * (level + 2) / 2) <= 600000 AND mid - (level + 1) * 500 > 0""")
def ladder_levels(spark, sf_dir):  # W14
    own = table(spark, sf_dir, "part").select("p_partkey", cents("p_retailprice").alias("mid"))
    return rows.ladder(own, F.col("mid"), F.lit(500), F.lit(2.0), F.lit(600000), 10).select("p_partkey", "level", "price")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_state(spark, sf_dir):  # J7 J8 S16 U3
    manifest = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), F.col("source").alias("key"))
    return files.pending(manifest, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("name"))).select(F.col("name").alias("doc_id"), F.col("key").alias("source"))


@query("""
WITH n AS (SELECT CAST(event_id AS VARCHAR) AS name, epoch_us(ts) AS t FROM events) SELECT name, t FROM n ORDER BY t DESC, name LIMIT 40""")
def manifest_newest(spark, sf_dir):  # K12 O11
    own = events(spark, sf_dir).select(F.col("event_id").cast("string").alias("name"), F.col("us").alias("t"))
    late = F.col("t") >= F.lit(1_705_000_000_000_000)
    return files.manifest_with(own.where(~late), own.where(late), 40)


@query("SELECT CAST(l_orderkey AS VARCHAR) AS key, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_orderkey")
def first_csv_column(spark, sf_dir):  # F9 S14
    own = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") == "A", F.concat_ws(",", "l_orderkey", "l_partkey")).otherwise("none,1").alias("value"))
    kept, _ = files.first_column(own)
    return kept.groupBy("key").agg(F.count("*").alias("n"))


@query("""SELECT conv_id, turn, CAST(conv_id AS VARCHAR) || ',' || CAST(turn AS VARCHAR) || ',' || CASE WHEN regexp_matches(text, '[,"\\r\\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END || ',' || CASE WHEN role = 'user' THEN 'true' ELSE 'false' END AS value FROM conversations""")
def csv_quoted(spark, sf_dir):  # K1 K2 K4
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", (F.col("role") == "user").alias("user"))
    named = [f for f in own.schema.fields]
    line = F.concat_ws(",", *(sinks.quoted(sinks.cell(f)) for f in named))
    return own.select("conv_id", "turn", line.alias("value"))


@query("""SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) || ' | ' || o_orderstatus || ' | ' || o_orderpriority AS line FROM orders""")
def order_log(spark, sf_dir):  # K13
    return table(spark, sf_dir, "orders").select("o_orderkey", sinks.order_line("o_orderkey", "o_orderstatus", "o_orderpriority").alias("line"))


@query("SELECT DISTINCT url FROM pages")
def distinct_paths(spark, sf_dir):  # U2
    return table(spark, sf_dir, "pages").select("url").distinct()


@query("WITH RECURSIVE f(n, value, following) AS (SELECT 1, CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, following, value + following FROM f WHERE n < 40) SELECT n, value FROM f")
def fib(spark, sf_dir):  # M10
    return algos.fibonacci(spark, 40)


@query("WITH RECURSIVE f(n, value) AS (SELECT 1, CAST(1 AS DECIMAL(38,0)) UNION ALL SELECT n + 1, CAST(value * (n + 1) AS DECIMAL(38,0)) FROM f WHERE n < 30) SELECT n, CAST(value AS VARCHAR) AS value FROM f")
def factorials(spark, sf_dir):  # M12
    return algos.factorials(spark, 30).select("n", F.col("value").cast("string").alias("value"))


@query("SELECT range AS prime FROM range(2, 2001) WHERE NOT EXISTS (SELECT 1 FROM range(2, 45) d(k) WHERE d.k < range AND range % d.k = 0)")
def sieve(spark, sf_dir):  # M11
    return algos.primes(spark, 2000)


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT s_nationkey AS src, (s_nationkey * 7 + 3) % 25 AS dst, CAST(s_nationkey % 5 + 1 AS BIGINT) AS weight FROM supplier UNION SELECT DISTINCT s_nationkey, (s_nationkey + 1) % 25, 4 FROM supplier),
p(node, distance, hops) AS (SELECT 0, CAST(0 AS BIGINT), 0 UNION SELECT e.dst, p.distance + e.weight, p.hops + 1 FROM p JOIN e ON e.src = p.node WHERE p.hops < 25 AND p.distance + e.weight <= 100)
SELECT CAST(node AS VARCHAR) AS node, min(distance) AS distance FROM p GROUP BY node""")
def shortest_path(spark, sf_dir):  # M8
    own = table(spark, sf_dir, "supplier").select("s_nationkey").distinct()
    n = F.col("s_nationkey")
    edges = own.select(n.alias("src"), ((n * 7 + 3) % 25).alias("dst"), (n % 5 + 1).alias("weight")).union(own.select(n, (n + 1) % 25, F.lit(4))).distinct()
    edges = edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.col("weight").cast("long").alias("weight"))
    return algos.shortest_paths(edges, "0").select("node", "distance")


@query("""
WITH RECURSIVE i AS (SELECT l_orderkey, l_linenumber AS w, CAST(l_quantity AS BIGINT) AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY """ + LINE_SQL + """) AS k FROM lineitem),
s AS (SELECT DISTINCT l_orderkey, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS value FROM i
    UNION SELECT s.l_orderkey, i.k, s.used + t * i.w, s.value + t * i.v FROM s JOIN i ON i.l_orderkey = s.l_orderkey AND i.k = s.k + 1, (VALUES (0), (1)) c(t) WHERE s.used + t * i.w <= 10)
SELECT l_orderkey, max(value) AS best FROM s GROUP BY l_orderkey""")
def knapsack(spark, sf_dir):  # M9
    own = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.collect_list(F.struct(F.col("l_linenumber").alias("w"), F.col("l_quantity").cast("int").alias("v"))).alias("i")
    )
    own = own.select("l_orderkey", F.transform("i", lambda x: x["w"]).alias("weights"), F.transform("i", lambda x: x["v"]).alias("values"), F.lit(10).alias("capacity"))
    return algos.knapsacks(own, ["l_orderkey"], "weights", "values", "capacity")


#: Rules on book updates in SQL.
DEPTH_RULES = {
    "rows_scanned == 0": "n = 0", "non_monotonic_ts > 0": "non_monotonic_ts > 0", "lastId < firstId (counted)": "last_lt_first > 0", "id_overlap_count > 0 (firstId <= prev.lastId)": "id_overlap > 0",
    "id_gap_count > 0 (firstId > prev.lastId+1)": "id_gap > 0", **{f"has_{s}_{f} but {s}_{f}_count==0": f"{s}_levels = 0" for f in ("px", "qty") for s in ("bid", "ask")},
    **{f"high_fraction_{s}_{f}_zero": f"{s}_{f}_zero * 10 > {s}_levels" for f in ("qty", "px") for s in ("bid", "ask")},
    **{f"per-row {s} counts mismatch rows_scanned": f"{s}_per_row AND {s}_levels <> n" for s in ("bid", "ask")},
    "flattened_bid_or_ask_arrays_without_offsets (informational)": "NOT bid_per_row AND bid_levels > 0 OR NOT ask_per_row AND ask_levels > 0",
}
DEPTH_NAMES = ["non_monotonic_ts", "last_lt_first", "id_overlap", "id_gap", "ask_levels", "bid_levels", "ask_empty", "bid_empty", "ask_px_min", "ask_qty_sum", "ask_qty_zero", "bid_qty_zero", "jumps"]


@query(f"""
WITH v AS (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS px, CAST(l_quantity AS BIGINT) % 9 AS qty FROM lineitem),
g AS (SELECT l_suppkey, l_orderkey, min(l_partkey) - (l_orderkey % 41 = 0)::INT * 5000 AS l, min(l_partkey) AS f, count(*) FILTER (l_returnflag <> 'R') AS a, count(*) FILTER (l_returnflag = 'R' AND l_suppkey % 10 <> 3) AS b,
    min(px) FILTER (l_returnflag <> 'R') AS apx, min(px) FILTER (l_returnflag = 'R' AND l_suppkey % 10 <> 3) AS bpx, coalesce(sum(qty) FILTER (l_returnflag <> 'R'), 0) AS aq,
    count(*) FILTER (l_returnflag <> 'R' AND qty = 0) AS az, count(*) FILTER (l_returnflag = 'R' AND l_suppkey % 10 <> 3 AND qty = 0) AS bz FROM v GROUP BY l_suppkey, l_orderkey),
w AS (SELECT *, lag(l) OVER o AS p, coalesce(apx, bpx) AS s, lag(coalesce(apx, bpx)) OVER o AS sp FROM g WINDOW o AS (PARTITION BY l_suppkey ORDER BY l_orderkey)),
m AS (SELECT l_suppkey, count(*) AS n, 0 AS non_monotonic_ts, count(*) FILTER (l < f) AS last_lt_first, count(*) FILTER (f <= p) AS id_overlap, count(*) FILTER (f > p + 1) AS id_gap, CAST(sum(a) AS BIGINT) AS ask_levels, CAST(sum(b) AS BIGINT) AS bid_levels,
    count(*) FILTER (a = 0) AS ask_empty, count(*) FILTER (b = 0) AS bid_empty, min(apx) AS ask_px_min, CAST(sum(aq) AS BIGINT) AS ask_qty_sum, CAST(sum(az) AS BIGINT) AS ask_qty_zero, CAST(sum(bz) AS BIGINT) AS bid_qty_zero,
    count(*) FILTER (s > 0 AND sp > 0 AND greatest(s, sp) > 10 * least(s, sp)) AS jumps, 0 AS ask_px_zero, 0 AS bid_px_zero, CASE WHEN l_suppkey % 4 = 1 THEN true WHEN l_suppkey % 4 = 2 THEN false END AS bid_per_row,
    CASE WHEN l_suppkey % 4 = 1 THEN true END AS ask_per_row FROM w GROUP BY l_suppkey)
SELECT l_suppkey, n AS "rows", {", ".join(DEPTH_NAMES)}, {rules_sql(DEPTH_RULES)} AS anomalies, true AS problematic,
    coalesce(bid_per_row AND bid_levels <> n, false) OR coalesce(ask_per_row AND ask_levels <> n, false) OR coalesce(NOT bid_per_row AND bid_levels > 0, false) AS information FROM m""")
def depth_audit(spark, sf_dir):  # R3 R4 A13-A17
    level = F.struct(cents("l_extendedprice").alias("px"), (F.col("l_quantity").cast("long") % 9).alias("qty"))
    bid = (F.col("l_returnflag") == "R") & (F.col("l_suppkey") % 10 != 3)
    sides = (F.array_sort(F.collect_list(F.when(c, level))).alias(side) for side, c in (("ask", F.col("l_returnflag") != "R"), ("bid", bid)))
    own = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.min("l_partkey").alias("firstId"), *sides)
    kind = F.col("l_suppkey") % 4
    own = own.withColumns({
        "lastId": F.col("firstId") - (F.col("l_orderkey") % 41 == 0).cast("int") * 5000, "bid_per_row": F.when(kind == 1, True).when(kind == 2, False), "ask_per_row": F.when(kind == 1, True),
    })
    out = audit.depth_audit(own, ["l_suppkey"], ["l_orderkey"], F.col("l_orderkey"), unit=1000, bucket=F.floor(F.col("l_orderkey") / 1000))
    information = F.exists("anomalies", lambda a: a.endswith("(informational)") | a.startswith("per-row"))
    return out.select("l_suppkey", "rows", *DEPTH_NAMES, F.array_join("anomalies", "|").alias("anomalies"), "problematic", information.alias("information"))


@query("""
WITH g AS (SELECT o_custkey, o_orderkey, o_orderkey % 3 = 0 AS empty FROM orders)
SELECT o_custkey, count(*) AS "rows", count(*) FILTER (empty) > 0 AS problematic, count(*) FILTER (empty) > 0 OR count(*) <> count(*) FILTER (NOT empty) OR o_custkey % 2 = 0 AND count(*) FILTER (NOT empty) > 0 AS problematic_with_info FROM g GROUP BY o_custkey""")
def audit_information(spark, sf_dir):  # R4
    """Books without a fault but empty sides: what counts as a problem with and without the flags that only inform."""
    n, level = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long"), F.struct(F.lit(5_000_000).cast("long").alias("px"), F.lit(10**8).cast("long").alias("qty"))
    over = F.struct(F.lit(6_000_000).cast("long").alias("px"), F.lit(10**8).cast("long").alias("qty"))
    none = F.array().cast("array<struct<px:bigint,qty:bigint>>")
    own = table(spark, sf_dir, "orders").select("o_custkey", n.alias("firstId"), n.alias("lastId"), *(F.when(F.col("o_orderkey") % 3 == 0, none).otherwise(F.array(x)).alias(s) for s, x in (("bid", level), ("ask", over))))
    own = own.withColumns({f"{s}_per_row": F.when(F.col("o_custkey") % 2 == 0, False) for s in ("bid", "ask")})
    out = audit.depth_audit(own, ["o_custkey"], ["firstId"], F.col("firstId"))
    return out.select("o_custkey", "rows", "problematic", "problematic_with_info")


@query("""
SELECT to_json({'user_id': user_id, 'rows': count(*), 'anomalies': CASE WHEN count(*) < 65 THEN ['small'] ELSE [] END}) AS value FROM events GROUP BY user_id HAVING count(*) < 65""")
def anomaly_lines(spark, sf_dir):  # K3 K4
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("rows"))
    return sinks.json_lines(counts.withColumn("anomalies", audit.named([("small", F.col("rows") < 65)])))


@query("SELECT 'audit' || chr(10) || 'user_id: ' || user_id || chr(10) || 'rows: ' || count(*) AS value FROM events GROUP BY user_id")
def audit_report(spark, sf_dir):  # K5
    return sinks.report_lines(table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("rows")), "audit")


@query(SERIES_SQL + f""", d AS (SELECT user_id, us, event_id, segment, y - avg(y) OVER (PARTITION BY user_id) AS d, count(*) OVER (PARTITION BY user_id) AS n FROM r),
l AS (SELECT *, {", ".join(f"lag(d, {k}) OVER w AS d{k}" for k in range(1, 6))} FROM d WINDOW w AS (PARTITION BY user_id, segment ORDER BY us, event_id)),
a AS (SELECT user_id, n, sum(d * d) AS g0, {", ".join(f"coalesce(sum(d * d{k}), 0) AS g{k}" for k in range(1, 6))} FROM l GROUP BY user_id, n HAVING n >= 10),
q AS (SELECT user_id, n, n * (n + 2) * ({" + ".join(f"(g{k} / g0) * (g{k} / g0) / (n - {k})" for k in range(1, 6))}) AS q FROM a)
SELECT user_id, n, round(q, 6) AS q, round(exp(-q / 2) * (1 + q / 2), 6) AS p_value FROM q""")
def ljung_box(spark, sf_dir):  # M4 M5
    out = arma.autocorrelations(_series(spark, sf_dir), ["user_id"], ["us", "event_id"], "y", 5, us_day()).where("n >= 10")
    return out.select("user_id", "n", F.round("q", 6).alias("q"), F.round(arma.p_value(F.col("q"), F.lit(4)), 6).alias("p_value"))


@query(None)
def takeuchi(spark, sf_dir):  # M13
    own = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") + 4).alias("x"), F.col("l_linenumber").alias("y"), (F.col("l_orderkey") % 4).alias("z")).distinct()
    return own.select("x", "y", "z", algos.taks("x", "y", "z").alias("value"))


@query(None)
def random_pick(spark, sf_dir):  # J9
    lists = {n: table(spark, sf_dir, t).select(F.col(c).alias("value")) for n, t, c in (("subject", "nation", "n_name"), ("place", "region", "r_name"))}
    return sorting.one_of_each(lists, 100, 3)


#: Events as a store of trades, a file for each market and day: ticks of clicks and views are futures, the others spot.
STORE_SQL = f"""WITH e AS (SELECT CASE WHEN event_type IN ('click', 'view') THEN 'fut' ELSE 'spot' END AS market, epoch_us(ts) * 1000 AS ts, event_id, {TRADE_SQL} FROM events)"""
STORE_DAY = 1_704_067_200 * 10**9  # the first day of events


def _store(spark, sf_dir) -> str:
    market = F.when(F.col("event_type").isin("click", "view"), "fut").otherwise("spot")
    own = _trades(spark, sf_dir).select(market.alias("market"), (F.col("us") * 1000).alias("ts"), "px", "qty", F.col("id").alias("tradeId"), F.col("event_id").alias("eventTime"))
    return store.written_days(own, store.new_folder(spark, "store"), "trade", "EV")


@query(STORE_SQL + f" SELECT market, CAST(market = 'spot' AS INTEGER) AS market_order, ts, px, id AS \"tradeId\" FROM e WHERE ts >= {STORE_DAY + 5 * 86_400 * 10**9 + 7} AND ts < {STORE_DAY + 11 * 86_400 * 10**9}")
def store_scan(spark, sf_dir):  # S1 S2 S4 F1c F2 F3
    out = ticks.scan(spark, _store(spark, sf_dir), "trade", "EV", None, STORE_DAY + 5 * 86_400 * 10**9 + 7, STORE_DAY + 11 * 86_400 * 10**9, "time, price, tid")
    return out.select("market", "market_order", "ts", "px", "tradeId")


@query(STORE_SQL + f""", f AS (SELECT *, 'bn_trade_' || market || '_EV_' || year(d) || '_' || month(d) || '_' || day(d) || '.parquet' AS file FROM (SELECT *, make_timestamp(ts // 1000) AS d FROM e)),
w AS (SELECT * EXCLUDE (d), ts - lag(ts) OVER (PARTITION BY file ORDER BY event_id) AS d FROM f),
m AS (SELECT file, {TRADE_MEASURES}, count(*) AS meta_rows, CAST(1 AS BIGINT) AS row_groups, false AS open_failed FROM w GROUP BY file
    UNION ALL BY NAME SELECT 'broken.parquet' AS file, 0 AS n, true AS open_failed UNION ALL BY NAME SELECT 'missing.parquet' AS file, 0 AS n, true AS open_failed),
z AS (SELECT *, {TRADE_SCORES} FROM m)
SELECT file, n AS "rows", meta_rows, row_groups, max_gap, dup_ids, qty_null, id_null, id_min, id_max, {rules_sql(META_RULES | TRADE_RULES | SIZE_RULES)} AS unordered FROM z""")
def store_audit(spark, sf_dir):  # S9 S10 A4 A5 A6 A8 R1 R5
    root = _store(spark, sf_dir)
    paths = [p for own in ticks.found_files(spark, root, "trade", "EV", None, 0, (1 << 63) - 1).values() for p in own]
    store.write_bytes(spark, f"{root}/broken.parquet", b"PAR1 and no more")
    name = F.regexp_extract("file", r"([^/]+\.parquet)(/[^/]*)?$", 1)
    feet = store.footers(spark, [*paths, f"{root}/broken.parquet", f"{root}/missing.parquet"]).withColumn("file", name)
    own = ticks.listed(spark, [*paths, f"{root}/missing.parquet"]).withColumn("file", name).withColumnsRenamed({"tradeId": "id", "eventTime": "event_id"})
    out = audit.trade_audit(own, ["file"], ["event_id"], F.col("ts"), "px", "qty", "id", footers=feet)
    # in the order of the rules above
    names = F.array(*(F.lit(n) for n in META_RULES | TRADE_RULES | SIZE_RULES))
    rules = F.array_join(F.filter(names, lambda n: F.array_contains("anomalies", n)), "|")
    return out.select("file", "rows", "meta_rows", "row_groups", "max_gap", "dup_ids", "qty_null", "id_null", "id_min", "id_max", rules.alias("unordered"))


@query("""WITH e AS (SELECT CAST(round(value * 100) AS BIGINT) AS v, epoch_us(ts) * 1000 AS us, date_trunc('hour', ts) AS h FROM events)
SELECT epoch_us(h) * 1000 AS ts, min(v) AS min_bid_px, max(v) AS max_bid_px, min(us) FILTER (v = lo) AS min_bid_ts, min(us) FILTER (v = hi) AS max_bid_ts
FROM (SELECT *, min(v) OVER (PARTITION BY h) AS lo, max(v) OVER (PARTITION BY h) AS hi FROM e) WHERE h >= TIMESTAMP '2024-01-03 12:00:00' GROUP BY h""")
def store_sampled(spark, sf_dir):  # S7
    hour = 3600 * 10**9
    own = events(spark, sf_dir).select((F.col("us") * 1000).alias("at"), F.expr(f"us * 1000 div {hour} * {hour}").alias("ts"), cents("value").alias("bid_px"), F.lit("fut").alias("market"))
    own = rows.extremes(own, ["ts", "market"], "at", ["bid_px"]).withColumnsRenamed({"min_bid_px_ts": "min_bid_ts", "max_bid_px_ts": "max_bid_ts"})
    root = store.written_days(own, store.new_folder(spark, "sampled"), "top", "EV", months=True)
    out = ticks.scan(spark, root, "top", "EV", "fut", STORE_DAY + 60 * hour, STORE_DAY + 365 * 24 * hour, "ts,min_bid_px,max_bid_px,min_bid_ts,max_bid_ts", sampled=True)
    return out.select("ts", "min_bid_px", "max_bid_px", "min_bid_ts", "max_bid_ts")


@query("""WITH v AS (SELECT epoch_us(o_orderdate) * 1000 + o_orderkey AS ts, l_extendedprice, l_quantity, l_returnflag FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '1995-04-11')
SELECT ts, coalesce(CAST(sum(CAST(l_quantity AS BIGINT)) FILTER (l_returnflag <> 'R') AS BIGINT), 0) AS ask_qty, count(*) FILTER (l_returnflag = 'R') AS bids FROM v GROUP BY ts""")
def store_depth(spark, sf_dir):  # S3 S5 S6
    level = F.struct(cents("l_extendedprice").alias("px"), F.col("l_quantity").cast("long").alias("qty"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.array_sort(F.collect_list(F.when(F.col("l_returnflag") != "R", level))).alias("ask"), F.array_sort(F.collect_list(F.when(F.col("l_returnflag") == "R", level))).alias("bid")
    )
    ts = (scalar.micros("o_orderdate") * 1000 + F.col("o_orderkey")).alias("ts")
    start, end = (F.expr(f"TIMESTAMP_NTZ '1995-{d} 00:00:00'") for d in ("02-20", "05-01"))
    own = table(spark, sf_dir, "orders").where(rows.in_range("o_orderdate", start, end)).join(lines, "o_orderkey").select(F.lit("spot").alias("market"), ts, "ask", "bid")
    root, first = store.written_days(own, store.new_folder(spark, "depth"), "depth", "OR"), 794_016_000 * 10**9
    out = ticks.scan(spark, root, "depth", "OR", None, first, first + 41 * 86_400 * 10**9, "ts,askqty,bidpx")
    return out.select("ts", F.aggregate("ask_qty", F.lit(0).cast("long"), lambda s, x: s + x).alias("ask_qty"), F.size("bid_px").cast("long").alias("bids"))


@query("""SELECT CAST(2024 AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, event_id, CAST(round(value * 100) AS BIGINT) AS px FROM events""")
def store_bars(spark, sf_dir):  # S8
    root = store.new_folder(spark, "bars")
    own = events(spark, sf_dir).select("event_id", cents("value").alias("px"))
    store.write_file(own, f"{root}/deep/er/bn_bars_EV_2024_1_1s.parquet")
    store.write_file(own.limit(0), f"{root}/bn_bars_EV_2024_2_1s.parquet")
    store.write_file(own, f"{root}/deep/bn_bars_OTHER_2024_1_1s.parquet")
    return ticks.bars(spark, root, "EV", "1s").select("year", "month", "event_id", "px")
