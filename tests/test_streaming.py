import numpy as np
from pyspark.sql import functions as F

from tickspark.operators.arma import OnlineFit
from tickspark.streaming import ingest, online


def test_files_are_read_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = spark.range(1).schema
    for k in range(2):
        spark.range(k * 3, k * 3 + 3).write.mode("append").parquet(src)
        ingest.append(ingest.new_files(spark, src, schema), out, ck).awaitTermination()
        assert spark.read.parquet(out).count() == 3 * (k + 1)


def test_online_fit(spark, tmp_path):
    y = np.random.default_rng(1).normal(size=40).tolist()
    fit = OnlineFit(1, 0, 10, 1e-6)
    wanted = [m[0] for v in y if (m := fit.add(v)) is not None]
    src, schema = str(tmp_path / "in"), "s int, k long, y double, starts boolean"
    for k in range(2):  # two batches: the state is carried over
        spark.createDataFrame([(0, i, y[i], False) for i in range(k * 20, k * 20 + 20)], schema).coalesce(1).write.mode("append").parquet(src)
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = online.fitted(rows, "s", "k", 1, 10).writeStream.format("memory").queryName("fits").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    got = spark.table("fits").orderBy("k").collect()
    assert np.allclose([r.guess for r in got], wanted)


def test_reserved(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "acc int, order_id long, cost double, open boolean, at long"
    spark.createDataFrame([(1, 10, 5.0, True, 0), (1, 11, 2.0, True, 1), (1, 10, 5.0, False, 2), (1, 11, 2.0, True, 3)], schema).coalesce(1).write.parquet(src)
    rows = spark.readStream.schema(schema).parquet(src)
    q = online.reserved(rows, "acc").writeStream.format("memory").queryName("held").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    assert sorted(r.reserved for r in spark.table("held").select(F.col("reserved")).collect()) == [2.0, 2.0, 5.0, 7.0]


def test_signals(spark, tmp_path):
    """The stream's decisions are those of the same two fits, row after row, over two batches and a new segment."""
    rng, src, schema = np.random.default_rng(2), str(tmp_path / "in"), "s int, k long, y double, starts boolean"
    y = [float(x) for x in 0.004 * np.sin(np.arange(60)) + rng.normal(0, 0.0005, 60)]
    fits, wanted = [OnlineFit(2, 0, h, 1e-6) for h in (5, 20)], {}
    for k, v in enumerate(y):
        if k == 40:
            for f in fits:
                f.restart()
        if None not in [f.add(v) for f in fits]:
            wanted[k] = [f.next() for f in fits]
    for k in range(2):
        spark.createDataFrame([(0, i, y[i], i == 40) for i in range(k * 30, k * 30 + 30)], schema).coalesce(1).write.mode("append").parquet(src)
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = online.signals(rows, "s", "k", 2, 5, 20).writeStream.format("memory").queryName("signals").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    got = {r.k: r for r in spark.table("signals").collect()}
    assert got.keys() == wanted.keys() and all(np.allclose([got[k].short, got[k].medium], wanted[k]) for k in wanted)
    sides = {r.side for r in got.values()}
    assert sides == {-1, 0, 1} and all(r.size > 0 and r.hold_bars >= 1 for r in got.values() if r.side)
    assert all((r.side > 0) == (r.short > 0) for r in got.values() if r.side)


def test_interval_trigger(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    spark.range(3).write.parquet(src)
    q = ingest.append(ingest.new_files(spark, src, spark.range(1).schema), out, ck, every="200 milliseconds")
    try:
        q.processAllAvailable()
        spark.range(3, 5).write.mode("append").parquet(src)
        q.processAllAvailable()
        assert q.isActive and spark.read.parquet(out).count() == 5
    finally:
        q.stop()
