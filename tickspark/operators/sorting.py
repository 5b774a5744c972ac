"""Orders, merges and searches over tables and lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickspark.operators.rows import numbered


def numeric_then_text(column: Column) -> list[Column]:
    """Numbers by value, then everything else by text: one total order, also where both kinds are mixed."""
    number = column.try_cast("double")
    return [number.isNull().asc(), number.asc(), column.asc()]


def by_length(column: Column) -> list[Column]:
    return [F.length(column).asc(), column.asc()]


def merged(sources: list[DataFrame], key: str, as_text: bool = False) -> DataFrame:
    """All rows of the sources by key, equal keys in the sources' order; every row stays. The sort spills where it must."""
    rows = reduce(lambda a, b: a.unionByName(b), (df.withColumn("src", F.lit(n)) for n, df in enumerate(sources)))
    return rows.orderBy(F.col(key).cast("string") if as_text else F.col(key), "src")


def search(lines: DataFrame, word: str, text: str = "value") -> DataFrame:
    return lines.where(F.col(text).contains(word))


def lines_of(text: Column) -> Column:
    """(number from 1, line) of every line of a text."""
    return F.transform(F.split(text, "\n", -1), lambda s, i: F.struct((i + 1).alias("line"), s.alias("value")))


def sorted_values(*columns: Column) -> Column:
    return F.array_sort(F.array(*columns))


def permutations(values: DataFrame, column: str, n: int) -> DataFrame:
    """All orders of n distinct values of a handful; each value is used once."""
    own = values.select(column).distinct()
    out = own.select(F.array(column).alias("p"))
    for _ in range(n - 1):
        out = out.join(F.broadcast(own), ~F.array_contains("p", F.col(column))).select(F.concat("p", F.array(column)).alias("p"))
    return out


def one_of_each(lists: dict[str, DataFrame], n: int, seed: int) -> DataFrame:
    """n rows of one value drawn from each list(value); the seed decides the draws; null from an empty list.

    Values are numbered and drawn by number, so a list may be of any size.
    """
    spark = next(iter(lists.values())).sparkSession
    out = spark.range(n).withColumnRenamed("id", "nth")
    for k, (name, df) in enumerate(lists.items()):
        text = F.col("value").cast("string")
        values = numbered(df.select("value", text.alias("__text")), ["__text"], F.substring(text, 1, 1), "__drawn").select("__drawn", F.col("value").alias(name))
        drawn = out.withColumn("__drawn", F.floor(F.rand(seed + k) * df.count()) + 1)
        out = drawn.join(values, "__drawn", "left").drop("__drawn")
    return out
