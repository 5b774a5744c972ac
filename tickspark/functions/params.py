"""Parsing of the parameters a reader or a fit takes: columns, kinds, markets, steps, half-lives, time bounds."""

from __future__ import annotations

import re

#: Names under which columns may be asked for.
ALIASES = {
    "top": {
        "ts": "ts time", "ask_px": "askpx px ask askprice", "ask_qty": "askqty qty asksize", "bid_px": "bidpx bid bidprice",
        "bid_qty": "bidqty bidsize", "valu": "valu value vol volume", "min_bid_px": "minbidpx", "max_bid_px": "maxbidpx",
        "min_ask_px": "minaskpx", "max_ask_px": "maxaskpx", "min_bid_ts": "minbidts", "max_bid_ts": "maxbidts",
        "min_ask_ts": "minaskts", "max_ask_ts": "maxaskts",
    },
    "depth": {
        "ts": "ts time", "firstId": "firstid fid", "lastId": "lastid lid", "eventTime": "eventtime evt event",
        "ask_px": "askpx px ask askprice", "ask_qty": "askqty qty asksize", "bid_px": "bidpx bid bidprice", "bid_qty": "bidqty bidsize",
    },
    "trade": {
        "ts": "ts time", "px": "px price", "qty": "qty size quantity", "tradeId": "tradeid tid", "buyerOrderId": "buyerorderid boid",
        "sellerOrderId": "sellerorderid soid", "tradeTime": "tradetime ttime", "isMarket": "ismarket market", "eventTime": "eventtime evt event",
    },
}
#: Columns that are only read when asked for.
ON_DEMAND = {"min_bid_px", "max_bid_px", "min_ask_px", "max_ask_px", "min_bid_ts", "max_bid_ts", "min_ask_ts", "max_ask_ts"}
NS = {"ns": 1, "us": 10**3, "µs": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}
#: The default time window, in seconds: 2023-01-01 to 2036-01-01.
DEFAULT_START, DEFAULT_END = 1672531200, 2082758400


def plain(token: str) -> str:
    """Lower case, letters and digits only."""
    return re.sub(r"[^a-z0-9]", "", token.lower())


def columns(kind: str, wanted: str | None) -> list[str]:
    """Columns of a kind for a comma-separated list of names or aliases; unknown names are ignored, no list: the defaults."""
    known = ALIASES[kind]
    if not wanted:
        return [c for c in known if c not in ON_DEMAND]
    by_alias = {a: c for c, names in known.items() for a in names.split()}
    asked = {by_alias[p] for t in wanted.split(",") if (p := plain(t)) in by_alias}
    return [c for c in known if c in asked]


def kind_and_market(text: str) -> tuple[str, str | None]:
    """top, trade or depth, with _fut or _spot behind it or nothing."""
    m = re.fullmatch(r"(top|trade|depth)(?:_(fut|spot))?", text.lower())
    if not m:
        raise ValueError(f"unknown type: {text}")
    return m[1], m[2]


def markets(text: str | None) -> list[str]:
    """Markets in reading order: futures, then spot where none is named."""
    if text is None:
        return ["fut", "spot"]
    found = {"fut": "fut", "future": "fut", "futures": "fut", "spot": "spot"}.get(text.lower())
    if not found:
        raise ValueError(f"unknown market: {text}")
    return [found]


def seconds_to_ns(seconds: float) -> int:
    """Nanoseconds, rounded, within 64 bits."""
    return max(-(1 << 63), min((1 << 63) - 1, round(seconds * 1e9)))


def number_like(text: str) -> bool:
    return bool(re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text))


def positional(arguments: list[str]) -> tuple[int, int, str | None]:
    """(start ns, end ns, columns) of positional arguments: up to two numbers in seconds; the last other one names columns."""
    free = [a for a in arguments if not a.startswith("--")]
    numbers = [float(a) for a in free if number_like(a)][:2]
    names = [a for a in free if not number_like(a)]
    start = seconds_to_ns(numbers[0] if numbers else DEFAULT_START)
    return start, seconds_to_ns(numbers[1] if len(numbers) > 1 else DEFAULT_END), names[-1] if names else None


def step(text: str) -> tuple[int, str]:
    """(ns, label) of a bar step: a bare whole number is in seconds; a unit is ns, us, ms, s, m or h."""
    m = re.fullmatch(r"(\d+)|(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h)", text.strip().lower())
    if not m:
        raise ValueError(f"unknown step: {text}")
    ns = int(m[1]) * NS["s"] if m[1] else round(float(m[2]) * NS[m[3]])
    if ns <= 0:
        raise ValueError(f"step must be positive: {text}")
    unit = next(u for u in ("h", "m", "s", "ms", "us", "ns") if ns % NS[u] == 0)
    return ns, f"{ns // NS[unit]}{unit}"


def half_lives(text: str) -> list[float]:
    out = [float(t) for t in text.split(",") if t.strip()]
    if not out or min(out) <= 0:
        raise ValueError(f"half-lives must be positive numbers: {text}")
    return out
