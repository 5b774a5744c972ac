"""Recorded results and edge cases of the operators."""

import json
import math
import random
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickspark.functions import scalar
from tickspark.operators import aggregates, algos, align, arbitrage, arma, audit, rows, sorting
from tickspark.sources import files, schemas, sinks, store, ticks

#: Ticks of three legs whose merge was recorded (time, bid, its quantity, ask, its quantity, id).
TICKS = {
    "b": """
        1749167923914269447,10148837000000,225905000,10148838000000,452576000,70516674721
        1749167923921603285,10148837000000,221175000,10148838000000,452576000,70516674730
        1749167923922361141,10148837000000,218518000,10148838000000,452576000,70516674731
        1749167923923339812,10148837000000,218518000,10148838000000,452582000,70516674734
        1749167923924350081,10148837000000,218518000,10148838000000,452534000,70516674735
        1749167923926320658,10148837000000,218518000,10148838000000,452582000,70516674736
        1749167923928571447,10148837000000,218911000,10148838000000,452582000,70516674737
        1749167923931464030,10148837000000,219210000,10148838000000,452582000,70516674738
        1749167924021386878,10148837000000,219210000,10148838000000,452588000,70516674773
        1749167924070424939,10148837000000,219196000,10148838000000,452588000,70516674792
    """,
    "x": """
        1749167951795343810,532,509550000000,533,29360000000,828486061
        1749167952103498925,532,509550000000,533,47870000000,828486062
        1749167952904503619,532,509550000000,533,29360000000,828486063
        1749168033930361124,532,509550000000,533,34090000000,828486086
        1749168036829328437,532,509550000000,533,29360000000,828486087
        1749168036928303225,532,504820000000,533,29360000000,828486088
        1749168039163481129,532,504820000000,533,68610000000,828486090
        1749168039166448109,532,486350000000,533,68610000000,828486091
        1749168039166448109,532,486350000000,533,145380000000,828486092
        1749168039244327965,532,486350000000,533,163890000000,828486095
    """,
    "z": """
        1749167924258797838,54010000,66580000000,54040000,122860000000,3363691853
        1749167925606490483,54020000,14120000000,54040000,122860000000,3363691855
        1749167925624673173,54020000,28240000000,54040000,122860000000,3363691857
        1749167926620306519,54020000,14120000000,54040000,122860000000,3363691860
        1749167926733337371,54010000,66580000000,54040000,122860000000,3363691861
        1749167929121473604,54020000,14120000000,54040000,122860000000,3363691870
        1749167929182374920,54020000,28240000000,54040000,122860000000,3363691871
        1749167929582463686,54020000,28240000000,54040000,30380000000,3363691875
        1749167935815314494,54020000,24360000000,54040000,30380000000,3363691885
        1749167937078725734,54020000,24360000000,54030000,14120000000,3363691887
    """,
}


def test_recorded_merge(spark, tmp_path):
    """Ten steps, none profitable, with the recorded limits and profits; the lines merge in time."""
    for n, text in TICKS.items():
        (tmp_path / f"{n}.csv").write_text("\n".join(text.split()))
    streams = {n: files.ticks(spark, f"{tmp_path}/{n}.csv") for n in TICKS}
    times = [r.ts for r in sorting.merged([df.select("ts") for df in streams.values()], "ts").collect()]
    assert len(times) == 30 and times == sorted(times)
    out = arbitrage.profits(align.as_of_from_start(streams, "ts", arbitrage.COLUMNS), compat=True).toPandas()
    assert len(out) == 10
    assert np.allclose(out.capital_direct, 0.000845352, rtol=1e-5) and np.allclose(out.profit_direct, -3.04365e-06, rtol=1e-5)
    assert np.allclose(out.capital_reverse, 76.2904, rtol=1e-5) and np.allclose(out.profit_reverse, -0.225324, rtol=1e-5)
    assert arbitrage.profitable(arbitrage.profits(align.as_of_from_start(streams, "ts", arbitrage.COLUMNS), compat=True)).count() == 0


def test_as_of_has_no_look_ahead(spark):
    rng = random.Random(1)
    data = {n: sorted(rng.sample(range(100), 12)) for n in "bxz"}
    streams = {n: spark.createDataFrame([(t, t) for t in ts], "ts long, v long") for n, ts in data.items()}
    plain = align.as_of(streams, "ts", "v", ["v"]).orderBy("ts", "stream").collect()
    cut = align.as_of(streams, "ts", "v", ["v"], bucket=F.floor(F.col("ts") / 10)).orderBy("ts", "stream").collect()
    assert plain == cut
    events = sorted((t, k) for k, n in enumerate("bxz") for t in data[n])
    wanted = []
    for k, (t, s) in enumerate(events):
        last = {e[1]: e[0] for e in events[: k + 1]}
        if len(last) == 3:
            wanted.append((t, s, last[0], last[1], last[2]))
    assert [(r.ts, r.stream, r.b_v, r.x_v, r.z_v) for r in plain] == wanted


def test_regression_numbers():
    assert arma.decay(4) == pytest.approx(0.8408964153, abs=1e-10) and arma.effective_size(4) == pytest.approx(6.2852135079, abs=1e-9)
    phi = [-0.2068430769, 0.0714487575, 0.0493365891, 0.1118151726, -0.0074849778]
    assert arma.dominant_root(phi) == pytest.approx(0.6490400333, abs=1e-8)
    assert arma.chi2_survival(0, 5) == 1 and arma.chi2_survival(3, 5) == pytest.approx(0.6999858, abs=1e-6) and arma.chi2_survival(90000, 15) == 0


def test_closed_form_is_the_recursion(spark):
    rng = np.random.default_rng(3)
    y = rng.normal(size=120)
    data = [(0, k, float(v), 0 if k < 50 else 1) for k, v in enumerate(y)]
    series = spark.createDataFrame(data, "s int, k int, y double, segment int")
    got = arma.solve_ar(arma.moments(arma.lagged(series, ["s"], ["k"], 2), ["s"], ["k"], 2, 20), ["s"], 2, 1e-3).first()
    fit = arma.OnlineFit(2, 0, 20, 1e-3)
    for _, k, v, _ in data:
        if k == 50:
            fit.restart()
        fit.add(v)
    assert got.used == 116 and np.allclose(got.theta, fit.theta)


def test_decisions(spark):
    row = spark.createDataFrame([(0.01, 0.02, 0.05), (0.01, -0.02, 0.05), (-0.01, -0.02, 0.05), (0.0001, 0.02, 0.05), (0.01, 0.02, 0.0)], "a double, b double, s double")
    c = F.lit
    got = [r[0] for r in row.select(arma.decision(F.col("a"), F.col("b"), F.col("s"), c(0.9), c(0.5), c(6.0), c(9.0), c(1.0))).collect()]
    assert [g.side for g in got] == [1, 0, -1, 0, 0] and got[0].size == pytest.approx(0.5 * math.expm1(0.01) / 0.05) and got[2].size > 0 and got[0].hold_bars == 7


def test_above_mean_so_far(spark):
    cases = [[100, 200, 150, 300], [], [100], [100] * 4, [10, 20, 30, 40, 50], [50, 40, 30, 20, 10], [10**9] * 3, [100, 50, 300, 200, 600, 100]]
    data = [(s, k, v) for s, vs in enumerate(cases) for k, v in enumerate(vs)]
    got = {r.s: r.above for r in rows.above_mean_so_far(spark.createDataFrame(data, "s int, k int, v long"), ["s"], ["k"], F.col("v")).collect()}
    assert [got.get(s, 0) for s in range(len(cases))] == [2, 0, 0, 0, 4, 0, 0, 3]


def test_gaps_at_the_threshold(spark):
    df = spark.createDataFrame([("a", 0), ("a", 10), ("a", 19), ("b", 5)], "s string, t long")
    got = {(r.s, r.kind, r.first_t, r.last_t, r.gap) for r in rows.gap_report(df, ["s"], ["t"], F.col("t"), 10, ["t"]).collect()}
    assert got == {("a", "first", 0, 0, 0), ("a", "gap", 0, 10, 10), ("a", "last", 19, 19, 0), ("b", "first", 5, 5, 0), ("b", "last", 5, 5, 0)}
    assert rows.gap_report(df.where("false"), ["s"], ["t"], F.col("t"), 10, ["t"]).count() == 0


def test_segments(spark):
    df = spark.createDataFrame([(k, t, v) for k, (t, v) in enumerate([(0, 1.0), (1, 1.0), (4, 1.0), (4, 1.0), (5, 0.0), (6, 1.0), (7, 2.0)])], "k int, t long, v double")
    got = rows.segments(df.withColumn("s", F.lit(1)), ["s"], ["k"], F.col("t"), 2, F.col("v") > 0).orderBy("k").collect()
    assert [(r.k, r.segment) for r in got] == [(0, 0), (1, 0), (2, 1), (3, 2), (5, 4), (6, 4)]
    out = arma.returns(rows.segments(df.withColumn("s", F.lit(1)), ["s"], ["k"], F.col("t"), 2, F.col("v") > 0), ["s"], ["k"], F.col("v")).collect()
    assert [(r.k, round(r.y, 6)) for r in sorted(out)] == [(1, 0.0), (6, round(math.log(2), 6))]


def test_audits(spark):
    book = spark.createDataFrame([(1, t, *v, 0) for t, v in enumerate([(5, 1, 6, 1), (5, 1, 6, 1), (7, 0, 6, 1), (6, 1, 6, 1)])], "s int, t long, bid_px long, bid_qty long, ask_px long, ask_qty long, valu long")
    got = audit.top_audit(book, ["s"], ["t"], F.col("t") * 200, unit=1).first()
    assert (got.crossed, got.crossed_or_touching, got.duplicate_snapshots, got.gaps_100ms, got.gaps_1s, got.bid_qty_zero) == (1, 2, 1, 3, 0, 1)
    assert got.anomalies == ["gaps_gt_100ms > 0", "cross_book_count > 0 (bid_px > ask_px)", "duplicate_snapshot_count > 0", "high_fraction_bid_qty_zero"]
    depth = spark.createDataFrame([(1, 0, 1, 5, [(1000, 10**8)], [(900, 3)]), (1, 1, 5, 6, [(20000, 7)], []), (1, 2, 9, 8, [], [])], schema="s int, t long, firstId long, lastId long, ask array<struct<px:long,qty:long>>, bid array<struct<px:long,qty:long>>")
    got = audit.depth_audit(depth, ["s"], ["t"], F.col("t")).first()
    assert (got.id_overlap, got.id_gap, got.last_lt_first, got.ask_levels, got.bid_empty, got.jumps, got.qty_not_div1e8, got.problematic) == (1, 1, 1, 2, 2, 1, 1, True)
    assert audit.top_audit(book.where("false"), ["s"], ["t"], F.col("t")).count() == 0


def test_trade_audit_scores(spark):
    data = [(s, k, 100 if s < 20 else 10**6, 1, s * 100 + min(k, 7)) for s in range(21) for k in range(10)]
    out = audit.trade_audit(spark.createDataFrame(data, "s int, t long, px long, qty long, id long"), ["s"], ["t"], F.col("t"), "px", "qty", "id").toPandas().set_index("s")
    assert list(out.anomalies[20]) == ["dup_tradeid > 0", "px_avg statistical_outlier"] and list(out.anomalies[3]) == ["dup_tradeid > 0"] and out.dup_ids[0] == 2


def test_tick_store(spark, tmp_path):
    day = 86_400 * 10**9
    for market, d in (("fut", 1), ("spot", 1), ("spot", 2)):
        path = f"{tmp_path}/depth_{market}/AB/1970/1/bn_depth_{market}_AB_1970_1_{d + 1}.parquet"
        spark.createDataFrame([(d * day + k, k, k, k, [(k, 1)], [(k, 2)]) for k in range(3)], schemas.DEPTH).coalesce(1).write.parquet(path)
    got = ticks.scan(spark, str(tmp_path), "depth", "AB", None, day + 1, 2 * day + 1, "ts,bidqty,fid")
    assert got.columns == ["ts", "firstId", "bid_qty", "market", "market_order"]
    assert sorted((r.market, r.ts) for r in got.collect()) == [("fut", day + 1), ("fut", day + 2), ("spot", day + 1), ("spot", day + 2), ("spot", 2 * day)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "bid:array<struct<qty:bigint>>" in plan and "lastId" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert ticks.scan(spark, str(tmp_path), "depth", "AB", "spot", 5, 5).count() == 0
    assert len(ticks.days(0, day)) == 1 and len(ticks.days(0, day + 1)) == 2
    assert ticks.month_files("r", "S", "fut", 0, 40 * day) == [("fut", "r/top_px_fut/S/bn_top_px_fut_S_1970_1.parquet"), ("fut", "r/top_px_fut/S/bn_top_px_fut_S_1970_2.parquet")]
    file = next((tmp_path / "depth_fut/AB/1970/1").glob("*.parquet/*.parquet"))
    (tmp_path / "broken.parquet").write_bytes(b"PAR1 and no more")
    paths = [str(file), str(file.parent), "/nowhere", f"{tmp_path}/broken.parquet", f"file://{file}"]
    foot = {r.file: tuple(r)[1:] for r in store.footers(spark, paths).collect()}
    assert [foot[p] for p in paths] == [(3, 1, False), (3, 1, False), (None, None, True), (None, None, True), (3, 1, False)]
    everything = ticks.scan(spark, str(tmp_path), "depth", "AB", "spot")  # so many days are listed, not looked for
    assert sorted(r.ts for r in everything.collect()) == [day, day + 1, day + 2, 2 * day, 2 * day + 1, 2 * day + 2]
    late = ticks.found_files(spark, str(tmp_path), "depth", "AB", None, day + 5, 100 * day)
    assert [[p.rpartition("_")[2] for p in own] for own in late.values()] == [["2.parquet"], ["2.parquet", "3.parquet"]]


def test_sampled_tops(spark, tmp_path):
    """Months' files with their extremes; a range of years lists the folder."""
    day, row = 86_400 * 10**9, list(range(14))
    for y, m, ts in ((1970, 1, 5 * day), (1970, 2, 40 * day), (1971, 3, 430 * day)):
        spark.createDataFrame([[ts, *row[1:]]], schemas.TOP_SAMPLED).coalesce(1).write.parquet(ticks.month_file(str(tmp_path), "AB", "fut", y, m))
    for end, n in ((50 * day, 2), (39 * day, 1), (500 * day, 3)):
        got = ticks.scan(spark, str(tmp_path), "top", "AB", "fut", 0, end, "ts,ask_px", sampled=True)
        assert got.count() == n and got.columns == ["ts", "ask_px", "market", "market_order"]
    with pytest.raises(ValueError):
        ticks.scan(spark, str(tmp_path), "top", "AB", sampled=True)
    assert {f.name for f in schemas.TOP_SAMPLED.fields} >= {"min_bid_px", "max_ask_ts"}


def test_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("1,2,3,4,5,6\n1,5,3,4,5,6\nx,2,3,4,5,6\n1,2\n")
    assert [tuple(r) for r in files.ticks(spark, f"{tmp_path}/t.csv").collect()] == [(1, 2e-8, 3e-8, 4e-8, 5e-8)]
    raw = spark.createDataFrame([('{"txid": "a", "weight": 5}',), ('[{"txid": "b", "weight": 8, "status": {"block_height": 3}}]',)], "value string")
    assert sorted(tuple(r) for r in files.transactions(raw).collect()) == [("a", 2, None, None), ("b", 2, 3, None)]
    kept, skipped = files.first_column(spark.createDataFrame([("12,a",), ("x1,b",)], "value string"))
    assert kept.first().key == "12" and skipped.count() == 1


def test_lines(spark):
    df = spark.createDataFrame([(1, 'a"b,c', True, bytearray(b"\xff")), (None, None, None, None)], "n int, s string, b boolean, x binary")
    assert [r.value for r in sinks.csv_lines(df).collect()] == ['1,"a""b,c",true,ff', ",,,"]
    assert sinks.semicolon_lines(df).first().value == '1;a"b,c;True;ff'
    out = sinks.json_lines(spark.createDataFrame([("f", ["x"]), ("g", [])], "file string, anomalies array<string>"))
    assert [json.loads(r.value) for r in out.collect()] == [{"file": "f", "anomalies": ["x"]}]


def test_scalars(spark):
    row = spark.range(1).select(
        scalar.iso_ms(F.lit(1_700_000_000_123_999_999)).alias("iso"), scalar.full_ns(F.lit(1_700_000_000_123_456_789)).alias("full"), scalar.iso_ms(F.lit(-1)).alias("before"),
        scalar.bits_reversed(F.lit(1), 32).alias("rev"), scalar.little_endian_hex(F.lit(0x01020304)).alias("hex"), scalar.alu("shr", F.lit(32769), F.lit(0)).alias("shr"),
        scalar.fixed(F.lit(150_000_000)).alias("px"), scalar.half_life(F.lit(0.5)).alias("hl"), scalar.close_profit(F.lit(100.0), F.lit(2.0), F.lit(5.0), F.lit(11.0), 0.0).alias("p"), scalar.old_pounds(F.lit(7.51)).alias("old"),
    ).first()
    assert row.iso == "2023-11-14T22:13:20.123Z" and row.full == "2023-11-14 22:13:20.123456789" and row.before == "1969-12-31T23:59:59.999Z"
    assert row.rev == "1" + "0" * 31 and row.hex == "04030201" and row.shr == 16384 and row.px == "1.50000000" and row.hl == 1 and row.p == pytest.approx(10) and row.old == "7.10.2"


def test_fills_and_runs(spark):
    df = spark.createDataFrame([(1, [("2", "3", 0.1), ("4", "1", 0.2)]), (2, [])], f"id int, fills array<{schemas.FILL.simpleString()}>")
    got = [r.s for r in df.select(aggregates.fill_summary(F.col("fills")).alias("s")).collect()]
    assert got[0].qty == 4 and got[0].avg_px == 2.5 and got[0].commission == pytest.approx(0.3) and got[1].avg_px is None
    runs = spark.createDataFrame([(0, k, v) for k, v in enumerate("aabba")], "s int, k int, v string")
    assert sorted((r.run, r.v, r.n) for r in aggregates.adjacent_groups(runs, ["s"], ["k"], "v", [F.count("*").alias("n")]).collect()) == [(1, "a", 2), (2, "b", 2), (3, "a", 1)]


def test_small_algorithms(spark):
    cases = [(7, [1, 3, 4, 5], [1, 4, 5, 7], 9), (10, [], [], 0), (0, [1, 2, 3], [10, 20, 30], 0), (5, [10, 20, 30], [5, 10, 15], 0), (10, [5, 20, 30], [3, 7, 3], 3), (6, [1, 2, 3], [2, 3, 4], 9)]
    sacks = spark.createDataFrame([(k, w, v, c) for k, (c, w, v, _) in enumerate(cases)], "k int, w array<int>, v array<int>, c int")
    assert {r.k: r.best for r in algos.knapsacks(sacks, ["k"], "w", "v", "c").collect()} == {k: x for k, (*_, x) in enumerate(cases)}
    fib = {r.n: r.value for r in algos.fibonacci(spark, 40).collect()}
    assert [fib[n] for n in (5, 6, 10, 15, 20, 40)] == [5, 8, 55, 610, 6765, 102334155]
    with pytest.raises(ValueError):
        algos.fibonacci(spark, -1)
    assert int(algos.doublings(spark, 64).orderBy(F.col("square").desc()).first().total) == 2**64 - 1
    plain = cache(lambda x, y, z: plain(plain(x - 1, y, z), plain(y - 1, z, x), plain(z - 1, x, y)) if y < x else z)
    known = {}
    assert all(algos.tak(x, y, z, known) == plain(x, y, z) for x in range(-3, 9) for y in range(-3, 9) for z in range(-3, 9))
    assert algos.tak(24, 16, 8) == plain(24, 16, 8) and algos.tak(6, 4, 2) == 3


def test_numbering_without_one_task(spark):
    df = spark.createDataFrame([(k * 7 % 101, k) for k in range(101)], "t long, id long")
    got = rows.numbered(df, ["t"], F.floor(F.col("t") / 10)).collect()
    assert all(r.nth == r.t + 1 for r in got)
    assert rows.numbered(df.where("false"), ["t"], F.col("t")).count() == 0


def test_offsets_and_bars(spark, tmp_path):
    df = spark.createDataFrame([("f", [0, 1, 2], 2), ("f", [0, 1], 2)], "file string, off array<int>, n int")
    assert audit.offset_faults(df, ["file"], "off", "n").first().offset_faults == 1
    spark.createDataFrame([(1, 2)], "ts long, bid_px long").coalesce(1).write.parquet(str(tmp_path / "x"))
    part = next((tmp_path / "x").glob("part*.parquet"))
    (tmp_path / "deep/er").mkdir(parents=True)
    part.rename(tmp_path / "deep/er/bn_bars_AB_2025_3_1s.parquet")
    got = ticks.bars(spark, str(tmp_path / "deep"), "AB", "1s").first()
    assert (got.year, got.month, got.ts) == (2025, 3, 1)
    assert ticks.directory(spark, str(tmp_path / "deep/er")).count() == 1
    assert ticks.listed(spark, [str(tmp_path / "deep/er/bn_bars_AB_2025_3_1s.parquet"), str(tmp_path / "none.parquet")]).count() == 1


def test_klines_and_writers(spark, tmp_path):
    bar = "17000000{:02d}000000,1,2,0.5,1.5,10,1700000001000000"
    (tmp_path / "k.csv").write_text(bar.format(1) + "\nbad,1,2,3,4,5,6\n1,2,3\n\n")
    (tmp_path / "full.csv").write_text("".join(bar.format(k) + ",15.5,3,5,7.75,0\n" for k in (2, 3)))
    got = files.klines(spark, f"{tmp_path}/k.csv", f"{tmp_path}/none.csv", f"{tmp_path}/full.csv")
    assert sorted((r.open_time, r.close) for r in got.collect()) == [(1700000000000000 + k * 10**6, 1.5) for k in (1, 2, 3)] and got.count() == 3
    assert files.klines(spark, f"{tmp_path}/none.csv").collect() == []
    (tmp_path / "p.csv").write_text("5,1.5,2\nx,1,2\n6,2.5,0.25\n")
    assert sorted(tuple(r) for r in files.prices(spark, f"{tmp_path}/p.csv").collect()) == [(5, 1.5, 2.0), (6, 2.5, 0.25)]
    df = spark.createDataFrame([(1, 'a"b', ["x"]), (2, "c", [])], "n int, s string, anomalies array<string>")
    sinks.write_anomalies(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1
    sinks.write_csv(df.select("n", "s"), str(tmp_path / "c"))
    assert [r.s for r in spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "c")).orderBy("n").collect()] == ['a"b', "c"]
    sinks.write_csv(df.select("n", "s"), str(tmp_path / "z"), codec="org.apache.hadoop.io.compress.GzipCodec")
    assert list((tmp_path / "z").glob("*.gz")) and spark.read.option("header", "true").csv(str(tmp_path / "z")).count() == 2
    sinks.write_models(spark.createDataFrame([(4.0, 0.1)], "hl double, phi double"), str(tmp_path / "m"))
    assert (tmp_path / "m/hl=4.0").exists()


def test_chi_square(spark):
    """Against the integral of the density; the p-value gates decisions at 0.01."""
    def integral(x, k):
        t = np.linspace(x, x + 400, 2_000_001)
        y = np.exp((k / 2 - 1) * np.log(t) - t / 2 - k / 2 * math.log(2) - math.lgamma(k / 2))
        return float(((y[1:] + y[:-1]) / 2).sum() * (t[1] - t[0]))

    for x, k in ((10, 5), (3, 5), (40, 15), (0.5, 1), (5, 2), (90, 100)):
        assert arma.chi2_survival(x, k) == pytest.approx(integral(x, k), rel=1e-5)
    assert arma.chi2_survival(10, 5) == pytest.approx(0.0752352, abs=1e-6) and arma.chi2_survival(90000, 15) == 0 and arma.chi2_survival(0, 3) == 1 and arma.chi2_survival(2, 0) == 0
    flat = spark.createDataFrame([(1, k, 2.0, 0) for k in range(9)] + [(2, k, float(k * k % 7), 0) for k in range(9)], "s int, t long, y double, segment int")
    got = {r.s: r for r in arma.autocorrelations(flat, ["s"], ["t"], "y", 2).withColumn("p", arma.p_value(F.col("q"), F.lit(1))).collect()}
    assert (got[1].rho_1, got[1].q, got[1].p) == (None, None, None) and 0 <= got[2].p <= 1


def test_buckets_give_what_one_task_gives(spark):
    """One symbol has all rows: with buckets, gaps, lags, sums, runs and segments are the same, and no task has them all."""
    rng = random.Random(4)
    t, data = 0, []
    for k in range(400):
        t += rng.choice([1, 1, 2, 3, 0, 40])
        data.append((1, t, k, rng.choice("aab"), float(rng.randint(1, 50)), rng.random() > 0.1))
    df = spark.createDataFrame(data, "s int, t long, k int, c string, v double, ok boolean")
    keys, order, bucket = ["s"], ["t", "k"], F.floor(F.col("t") / 25)

    def same(f):
        a, b = (sorted(map(str, f(x).collect())) for x in (None, bucket))
        assert a == b and a

    value = F.col("v").cast("long")
    same(lambda b: rows.gap_report(df, keys, order, F.col("t"), 5, ["t", "k"], bucket=b))
    same(lambda b: rows.spikes(df, keys, order, value, bucket=b))
    same(lambda b: rows.above_mean_so_far(df, keys, order, value, b))
    same(lambda b: rows.running_mean(df, keys, order, value, bucket=b))
    same(lambda b: rows.lagged(df, keys, order, {"x": ("v", 3), "y": ("c", 1)}, b))
    same(lambda b: aggregates.adjacent_groups(df, keys, order, "c", [F.count("*").alias("n"), F.sum("v").alias("v")], b))
    made = rows.segments(df, keys, order, F.col("t"), 5, F.col("ok"))
    same(lambda b: rows.segments(df, keys, order, F.col("t"), 5, F.col("ok"), b))
    same(lambda b: arma.returns(made, keys, order, F.col("v"), bucket=b).select("k", "y"))
    series = arma.returns(made, keys, order, F.col("v"))
    same(lambda b: arma.lagged(series, keys, order, 2, b))
    same(lambda b: arma.split(series, keys, order, 0.3, b).select("k", "test"))
    same(lambda b: arma.autocorrelations(series, keys, order, "y", 3, b).select("n", F.round("rho_2", 9), F.round("q", 9)))
    same(lambda b: arma.moments(arma.lagged(series, keys, order, 1), keys, order, 1, 20, b).select("used", F.round("s0_0", 9), F.round("b1", 9)))
    held = rows.with_last(df, keys, order, 3, bucket).groupBy("__bucket").count().collect()
    assert len(held) > 20 and max(r["count"] for r in held) < 60


def test_zstd_round_trip(spark, tmp_path):
    lines = [f"{k},é {k * k}" for k in range(5000)]
    frames = sinks.zstd_frames(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(2)).collect()
    for k, own in enumerate((frames[:1], frames[1:])):
        (tmp_path / f"{k}.zst").write_bytes(b"".join(bytes(r.frame) for r in own))
    got = files.zstd_lines(spark, f"{tmp_path}/0.zst", f"{tmp_path}/1.zst")
    assert sorted(r.value for r in got.collect()) == sorted(lines) and got.select("file").distinct().count() == 2
