"""Small algorithms as queries: recursion, shortest paths, primes, packing a knapsack."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickspark.sources.store import shared_dir


def fibonacci(spark: SparkSession, n: int) -> DataFrame:
    """(n, value) of the numbers 1 to n by a recursive query."""
    if n < 0:
        raise ValueError("n must not be negative")
    return spark.sql(f"""
        WITH RECURSIVE f(n, value, following) AS (
            SELECT 1, CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, following, value + following FROM f WHERE n < {n}
        ) SELECT n, value FROM f WHERE n <= {n}""")


def factorials(spark: SparkSession, n: int) -> DataFrame:
    """(n, value) for 1 to n, at most 33: what 38 digits hold."""
    if not 0 <= n <= 33:
        raise ValueError("n must be from 0 to 33")
    return spark.sql(f"""
        WITH RECURSIVE f(n, value) AS (
            SELECT 1, CAST(1 AS DECIMAL(38,0)) UNION ALL SELECT n + 1, CAST(value * (n + 1) AS DECIMAL(38,0)) FROM f WHERE n < {n}
        ) SELECT n, value FROM f WHERE n <= {n}""")


def doublings(spark: SparkSession, n: int) -> DataFrame:
    """(square, grains, total) of the first n squares, at most 64, where each has twice the grains of the one before."""
    rows = spark.range(1, n + 1).withColumnRenamed("id", "square")
    # two factors that 64 bits hold: a double wouldn't be exact
    a, b = (F.expr(f"CAST(shiftleft(1L, CAST({e} AS INT)) AS DECIMAL(19,0))") for e in ("(square - 1) div 2", "square div 2"))
    grains = (a * b).cast("decimal(38,0)")
    return rows.select("square", grains.alias("grains"), (grains * 2 - 1).cast("decimal(38,0)").alias("total"))


def primes(spark: SparkSession, n: int) -> DataFrame:
    """Primes to n: numbers that no product of two others reaches; products are generated, not all pairs."""
    multiples = spark.range(2, int(n**0.5) + 1).select(F.explode(F.sequence(F.col("id") * F.col("id"), F.lit(n), F.col("id"))).alias("id"))
    return spark.range(2, n + 1).join(multiples.distinct(), "id", "left_anti").withColumnRenamed("id", "prime")


def shortest_paths(edges: DataFrame, start: str, rounds: int | None = None) -> DataFrame:
    """(node, distance, path) from start over edges(src, dst, weight): rounds of relaxation until nothing gets shorter.

    A round is one join and one aggregation over the nodes that changed; ties take the first path in order.
    """
    spark = edges.sparkSession
    shared_dir(spark)  # where checkpoints go
    best = spark.createDataFrame([(start, 0, [start])], "node string, distance long, path array<string>")
    changed, turn = best, 0
    while rounds is None or turn < rounds:
        step = changed.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), (F.col("distance") + F.col("weight")).alias("distance"), F.concat("path", F.array("dst")).alias("path"))
        step = step.groupBy("node").agg(F.min(F.struct("distance", "path")).alias("n"))
        old = best.select("node", F.col("distance").alias("d"))
        changed = step.join(old, "node", "left").where("d IS NULL OR n.distance < d").select("node", "n.distance", "n.path").checkpoint()
        if changed.isEmpty():
            break
        best = best.join(changed.select("node"), "node", "left_anti").unionByName(changed).checkpoint()
        turn += 1
    return best


def knapsack(weights: Column, values: Column, capacity: Column) -> Column:
    """The greatest value that fits, each item once; weights and values are arrays, an item of negative weight is left out.

    The best value of each capacity, from 0, is an array that every item makes anew; 0 without items.
    """
    none = F.array_repeat(F.lit(0).cast("long"), capacity.cast("int") + 1)

    def with_item(best: Column, item: Column) -> Column:
        w, v = item["w"].cast("int"), item["v"].cast("long")
        return F.transform(best, lambda b, c: F.when((w >= 0) & (w <= c), F.greatest(b, F.get(best, c - w) + v)).otherwise(b))

    items = F.zip_with(weights, values, lambda w, v: F.struct(w.alias("w"), v.alias("v")))
    return F.element_at(F.aggregate(items, none, with_item), -1)


def knapsacks(df: DataFrame, keys: list[str], weights: str, values: str, capacity: str) -> DataFrame:
    """(keys, best) of rows with arrays of weights and values."""
    return df.select(*keys, knapsack(F.col(weights), F.col(values), F.col(capacity)).alias("best"))


def tak(x: int, y: int, z: int, known: dict[tuple[int, int, int], int] | None = None) -> int:
    """z if y is x or more, else tak of the three taks with one of the arguments less by one.

    Calls wait on a list of their own, so that depth is bounded by memory alone; known keeps values of one call.
    """
    known = {} if known is None else known
    todo = [(x, y, z)]
    while todo:
        a, b, c = now = todo[-1]
        if b >= a:
            known[now] = c
        if now in known:
            todo.pop()
            continue
        inner = [(a - 1, b, c), (b - 1, c, a), (c - 1, a, b)]
        if missing := [i for i in inner if i not in known]:
            todo += missing
        elif (last := tuple(known[i] for i in inner)) in known:
            known[now] = known[last]
        else:
            todo.append(last)
    return known[x, y, z]


def taks(x: str, y: str, z: str) -> Column:
    """tak of three columns; values that a batch's rows share are found once."""

    def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        known: dict[tuple[int, int, int], int] = {}
        return pd.Series([tak(int(i), int(j), int(k), known) for i, j, k in zip(a, b, c, strict=True)], dtype="int64")

    return F.pandas_udf(run, "long")(x, y, z)
