import pytest

from tickspark.functions import params


def test_columns():
    assert params.columns("top", "Bid Px, ASK, nothing, time") == ["ts", "ask_px", "bid_px"]
    assert params.columns("top", None) == ["ts", "ask_px", "ask_qty", "bid_px", "bid_qty", "valu"]
    assert params.columns("trade", "is_market,qty") == ["qty", "isMarket"]
    assert params.columns("depth", "fid,evt") == ["firstId", "eventTime"]
    assert params.columns("top", "max_ask_ts") == ["max_ask_ts"]


def test_kinds_and_markets():
    assert params.kind_and_market("DEPTH_spot") == ("depth", "spot") and params.kind_and_market("top") == ("top", None)
    assert params.markets(None) == ["fut", "spot"] and params.markets("Futures") == ["fut"]
    for bad in (lambda: params.kind_and_market("depths"), lambda: params.markets("swap"), lambda: params.step("3d"), lambda: params.half_lives("0")):
        with pytest.raises(ValueError):
            bad()


def test_times():
    assert params.seconds_to_ns(1.5) == 1_500_000_000 and params.seconds_to_ns(1e30) == (1 << 63) - 1
    assert params.positional(["10", "--raw", "20.5", "ts,px"]) == (10 * 10**9, 20_500_000_000, "ts,px")
    assert params.positional([]) == (params.DEFAULT_START * 10**9, params.DEFAULT_END * 10**9, None)
    assert params.step("5") == (5 * 10**9, "5s") and params.step("0.5s") == (5 * 10**8, "500ms") and params.step("60m") == (3600 * 10**9, "1h")
    assert params.half_lives("4, 16,") == [4.0, 16.0]
