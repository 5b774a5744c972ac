"""Grouped results: modes, adjacent groups, budgets, receipts, fills, tables, counts of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickspark.operators.rows import lagged, running


def modes(df: DataFrame, column: str) -> DataFrame:
    """All most frequent values with their count; only the greatest count goes to every task."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.max("n").alias("n"))), "n").select(column, "n")


def adjacent_groups(df: DataFrame, keys: list[str], order: list[str], column: str, measures: list[Column], bucket: Column | None = None) -> DataFrame:
    """Measures of each run of equal neighbours in a series; the same value after another one is a run of its own."""
    rows = lagged(df.withColumn("__row", F.lit(1)), keys, order, {"__last": (column, 1), "__before": ("__row", 1)}, bucket)
    new = ~F.col(column).eqNullSafe(F.col("__last")) | F.col("__before").isNull()
    rows = running(rows.withColumn("__new", new.cast("int")), keys, order, {"run": F.col("__new")}, bucket)
    return rows.groupBy(*keys, "run", column).agg(*measures)


def sales(units: str, revenue: str) -> list[Column]:
    n, total = F.sum(units), F.sum(revenue)
    return [n.alias("units"), total.alias("revenue"), F.when(n == 0, 0.0).otherwise(total / n).alias("average")]


def budget(expenses: DataFrame, keys: list[str], income: Column, amount: str) -> DataFrame:
    rows = expenses.groupBy(*keys).agg(F.max(income).alias("income"), F.sum(amount).alias("total"))
    return rows.withColumns({"savings": F.col("income") - F.col("total"), "exceeds": F.col("total") > F.col("income")})


def receipt(items: DataFrame, keys: list[str], price: Column, quantity: Column, from_: float = 100.0, discount: float = 0.1, tax: float = 0.07) -> DataFrame:
    """Subtotal, discount from an amount on, tax on what is left, total."""
    rows = items.groupBy(*keys).agg(F.sum(price * quantity).alias("subtotal"))
    rows = rows.withColumn("discount", F.when(F.col("subtotal") >= from_, F.col("subtotal") * discount).otherwise(0.0))
    rows = rows.withColumn("tax", (F.col("subtotal") - F.col("discount")) * tax)
    return rows.withColumn("total", F.col("subtotal") - F.col("discount") + F.col("tax"))


def fill_summary(fills: Column) -> Column:
    """(qty, avg_px, commission) of an array of fills whose price and qty may be text."""
    zero = F.lit(0.0)
    qty = F.aggregate(fills, zero, lambda s, f: s + F.coalesce(f["qty"].cast("double"), zero))
    cash = F.aggregate(fills, zero, lambda s, f: s + F.coalesce(f["price"].cast("double") * f["qty"].cast("double"), zero))
    paid = F.aggregate(fills, zero, lambda s, f: s + F.coalesce(f["commission"], zero))
    return F.struct(qty.alias("qty"), F.when(qty > 0, cash / qty).alias("avg_px"), paid.alias("commission"))


def table_of(df: DataFrame, rows: str, column: str, values: list[str], measure: Column) -> DataFrame:
    """A row for each of rows, a column for each of the values given, so that no pass over the data finds them."""
    return df.groupBy(rows).pivot(column, values).agg(measure)


def text_counts(text: Column) -> dict[str, Column]:
    """Words (spaces and one), letters and characters of a text."""
    return {"words": F.length(text) - F.length(F.replace(text, F.lit(" "))) + 1, "letters": F.length(F.regexp_replace(text, "[^A-Za-z]", "")), "chars": F.length(text)}
