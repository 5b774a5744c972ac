"""Scalar functions on columns: times, fixed-point numbers, bits, prices and fees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 100_000_000
DAY_NS = 86_400 * 10**9
EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, {ts})")


def nanos(ts: str) -> Column:
    return micros(ts) * 1000


def whole(value: Column, by: int) -> Column:
    """value / by, rounded down, in whole numbers: a double can't hold nanoseconds."""
    return F.call_function("div", value - F.pmod(value, F.lit(by)), F.lit(by))


def iso_ms(ns: Column) -> Column:
    """2024-01-31T12:00:00.123Z; floors, also before 1970."""
    ms = whole(ns, 1_000_000)
    day, rest = whole(ms, 86_400_000).cast("int"), F.pmod(ms, F.lit(86_400_000)).cast("int")
    return F.concat(
        F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), day), "yyyy-MM-dd"),
        F.format_string("T%02d:%02d:%02d.%03dZ", whole(rest, 3_600_000), whole(rest, 60_000) % 60, whole(rest, 1000) % 60, rest % 1000),
    )


def full_ns(ns: Column) -> Column:
    """2024-01-31 12:00:00.123456789."""
    text = F.translate(iso_ms(ns), "TZ", " ")
    return F.concat(F.substring(text, 1, 19), F.lit("."), F.lpad(F.pmod(ns, F.lit(10**9)).cast("string"), 9, "0"))


def day_start(ns: Column) -> Column:
    return ns - F.pmod(ns, F.lit(DAY_NS))


def unscaled(value: Column) -> Column:
    """The number that a fixed-point integer stands for."""
    return value / SCALE


def fixed(value: Column, places: int = 8) -> Column:
    return F.format_string(f"%.{places}f", unscaled(value))


# bits


def power_of_two(n: Column) -> Column:
    return (n > 0) & (n.bitwiseAND(n - 1) == 0)


def bits_reversed(n: Column, width: int = 64) -> Column:
    """The bits of n in reverse, as a string of width digits."""
    return F.reverse(F.substring(F.lpad(F.bin(n), 64, "0"), 65 - width, width))


def bytes_joined(high: Column, low: Column) -> Column:
    """A 16-bit number of two bytes."""
    return F.shiftleft(high.bitwiseAND(255), 8).bitwiseOR(low.bitwiseAND(255))


def byte_replaced(n: Column, nth: int, byte: Column) -> Column:
    mask = ~(255 << 8 * nth) & (1 << 64) - 1
    return n.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).bitwiseOR(F.shiftleft(byte.bitwiseAND(255), 8 * nth))


def little_endian_hex(n: Column, width: int = 4) -> Column:
    """The bytes of n as they lie in memory, lower-case hex."""
    digits = F.lower(F.substring(F.lpad(F.hex(n), 16, "0"), 17 - 2 * width, 2 * width))
    return F.concat(*(F.substring(digits, 2 * width - 2 * k - 1, 2) for k in range(width)))


def alu(op: str, a: Column, b: Column) -> Column:
    """A 16-bit operation: add, sub, and, or, xor, not, shl, shr."""
    made = {
        "add": a + b, "sub": a - b, "and": a.bitwiseAND(b), "or": a.bitwiseOR(b), "xor": a.bitwiseXOR(b), "not": F.bitwise_not(a),
        "shl": F.shiftleft(a, 1), "shr": F.shiftright(a.bitwiseAND(65535), 1),
    }
    return made[op].bitwiseAND(65535)


def alu_flags(a: Column, b: Column) -> tuple[Column, Column, Column, Column]:
    """(zero, negative, carry, overflow) of the 16-bit sum."""
    total = alu("add", a, b)
    sign = lambda x: x.bitwiseAND(32768) != 0
    return total == 0, sign(total), (a.bitwiseAND(65535) + b.bitwiseAND(65535)) > 65535, (sign(a) == sign(b)) & (sign(total) != sign(a))


# prices


def chain(capital: Column, legs: list[tuple[str, Column, float]]) -> Column:
    """What is left of capital after each leg: 'buy' divides by the price, 'sell' multiplies; each pays its fee."""
    return reduce(lambda c, leg: (c / leg[1] if leg[0] == "buy" else c * leg[1]) * (1 - leg[2]), legs, capital)


def direct_profit(c: Column, b_ask: Column, x_ask: Column, z_bid: Column, fees: tuple[float, float, float] = (0.00075,) * 3) -> Column:
    return chain(c, [("buy", b_ask, fees[0]), ("buy", x_ask, fees[1]), ("sell", z_bid, fees[2])]) - c


def reverse_profit(c: Column, z_ask: Column, x_bid: Column, b_bid: Column, fees: tuple[float, float, float] = (0.00075,) * 3) -> Column:
    return chain(c, [("buy", z_ask, fees[0]), ("sell", x_bid, fees[1]), ("sell", b_bid, fees[2])]) - c


def close_profit(c: Column, b: Column, x: Column, z: Column, fee: float) -> Column:
    """The direct chain on closing prices, as one product."""
    return c * z * (1 - fee) ** 3 / (b * x) - c


def taker(side: Column, price: Column, best_bid: Column, best_ask: Column) -> Column:
    return F.when(side == "BUY", price >= best_ask).otherwise(price <= best_bid)


def fee(px: Column, qty: Column, is_taker: Column, maker: float = 0.0001, take: float = 0.0004) -> Column:
    return px * qty * F.when(is_taker, take).otherwise(maker)


def may_post(side: Column, price: Column, best_bid: Column, best_ask: Column, commission: Column) -> Column:
    """Whether an order would rest in the book, free of commission."""
    return F.when(side == "BUY", price < best_ask).otherwise(price > best_bid) & (commission == 0)


def relative_move(log_return: Column) -> Column:
    return F.expm1(log_return)


def half_life(rho: Column) -> Column:
    """Bars until a shock halves; infinite unless 0 < rho < 1."""
    return F.when((rho > 0) & (rho < 1), F.lit(-0.6931471805599453) / F.ln(rho)).otherwise(F.lit(float("inf")))


def position_size(expected: Column, sigma: Column, kappa: float, most: float) -> Column:
    return F.when(sigma > 0, F.greatest(F.lit(-most), F.least(F.lit(most), kappa * expected / sigma))).otherwise(0.0)


# fractions (numerator, denominator), not reduced


def fraction(op: str, a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    return {"add": (a * d + c * b, b * d), "sub": (a * d - c * b, b * d), "mul": (a * c, b * d), "div": (a * d, b * c)}[op]


def old_pounds(pounds: Column) -> Column:
    """Pounds, shillings and pence of a decimal amount: 20 shillings of 12 pence each."""
    shillings = (pounds - F.floor(pounds)) * 20
    return F.concat_ws(".", F.floor(pounds), F.floor(shillings), F.floor((shillings - F.floor(shillings)) * 12))
