"""Triangular arbitrage over aligned legs b (quote per first), x (first per second), z (quote per second)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickspark.functions.scalar import direct_profit, reverse_profit

COLUMNS = ["bid_px", "bid_qty", "ask_px", "ask_qty"]


def limits(capital: float, compat: bool = False) -> dict[str, Column]:
    """What the legs' quantities let through, in quote currency, and which leg limits.

    compat keeps two units as in recorded results: the first path's middle leg by z's bid and the labels that go with it.
    """
    c = {f"{leg}_{n}": F.col(f"{leg}_{n}") for leg in "bxz" for n in COLUMNS}
    d1 = c["b_ask_qty"] * c["b_ask_px"]
    middle = c["x_ask_qty"] * c["x_ask_px"]
    d2 = middle * (c["z_bid_px"] if compat else c["b_ask_px"])
    d3 = c["z_bid_qty"] * c["z_bid_px"]
    direct = F.least(F.lit(capital), d1, d2, d3)
    r1 = c["z_ask_qty"] * c["z_ask_px"]
    r2 = c["x_bid_qty"] * c["x_bid_px"] * c["b_ask_px"]
    reverse = F.least(F.lit(capital), r1, r2)
    second = middle if compat else d2
    other = c["x_bid_qty"] * c["x_bid_px"] * c["z_ask_px"] if compat else r2
    # fixed values: the names of the limits
    return {
        "capital_direct": direct,
        "limit_direct": F.when(direct >= capital, "-").when(direct == d1, "BTC ask vol").when(direct == second, "XTZ ask vol").when(direct == d3, "XTZ/USDT bid vol").otherwise("-"),
        "capital_reverse": reverse,
        "limit_reverse": F.when(reverse >= capital, "-").when(reverse == r1, "XTZ ask vol").when(reverse == other, "BTC bid vol").otherwise("-"),
    }


def profits(legs: DataFrame, capital: float = 100.0, fee: float = 0.00075, compat: bool = False) -> DataFrame:
    """legs with the capital both ways round can use, its limit and its profit after fees."""
    rows = legs.withColumns(limits(capital, compat))
    return rows.withColumns({
        "profit_direct": direct_profit(F.col("capital_direct"), F.col("b_ask_px"), F.col("x_ask_px"), F.col("z_bid_px"), (fee,) * 3),
        "profit_reverse": reverse_profit(F.col("capital_reverse"), F.col("z_ask_px"), F.col("x_bid_px"), F.col("b_bid_px"), (fee,) * 3),
    })


def profitable(rows: DataFrame) -> DataFrame:
    return rows.where("profit_direct > 0 OR profit_reverse > 0")


def totals(rows: DataFrame) -> DataFrame:
    """(mode, total_direct, total_reverse): summed profits of the positive sides, and of both sides whenever one is positive.

    One pass gives all four sums.
    """
    sides, either = ("direct", "reverse"), (F.col("profit_direct") > 0) | (F.col("profit_reverse") > 0)
    kept = {"positive side": lambda s: F.col(f"profit_{s}") > 0, "either side": lambda s: either}
    sums = [F.struct(F.lit(mode).alias("mode"), *(F.sum(F.when(keep(s), F.col(f"profit_{s}")).otherwise(0.0)).alias(f"total_{s}") for s in sides)) for mode, keep in kept.items()]
    return rows.agg(F.array(*sums).alias("t")).select(F.inline("t"))


def best(rows: DataFrame, n: int, tie: str) -> DataFrame:
    return rows.orderBy(F.greatest("profit_direct", "profit_reverse").desc(), tie).limit(n)
