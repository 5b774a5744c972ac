"""Schemas by kind. Times are nanoseconds since 1970 UTC; prices and quantities are integers of 1e-8."""

from pyspark.sql import types as T


def _longs(names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names.split()]


LEVELS = T.ArrayType(T.StructType(_longs("px qty")))
TOP = T.StructType(_longs("ts ask_px ask_qty bid_px bid_qty valu"))
TOP_SAMPLED = T.StructType([*TOP.fields, *_longs("min_bid_px max_bid_px min_ask_px max_ask_px min_bid_ts max_bid_ts min_ask_ts max_ask_ts")])
TRADE = T.StructType([*_longs("ts px qty tradeId buyerOrderId sellerOrderId tradeTime"), T.StructField("isMarket", T.BooleanType()), *_longs("eventTime")])
DEPTH = T.StructType([*_longs("ts firstId lastId eventTime"), T.StructField("ask", LEVELS), T.StructField("bid", LEVELS)])
TICK_CSV = T.StructType(_longs("ts bid_px bid_qty ask_px ask_qty update_id"))
PRICE_CSV = T.StructType([*_longs("ts"), T.StructField("price", T.DoubleType()), T.StructField("volume", T.DoubleType())])
KLINE_CSV = T.StructType([*_longs("open_time"), *(T.StructField(n, T.DoubleType()) for n in ("open", "high", "low", "close", "volume")), *_longs("close_time")])
TRANSACTION = T.StructType([
    T.StructField("txid", T.StringType()), T.StructField("weight", T.LongType()),
    T.StructField("status", T.StructType(_longs("block_height block_time"))),
])
MANIFEST = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("key", T.StringType()), T.StructField("t", T.LongType()), T.StructField("size", T.LongType()),
    T.StructField("sha256", T.StringType()), T.StructField("compressed", T.BooleanType()),
])
FILL = T.StructType([T.StructField("price", T.StringType()), T.StructField("qty", T.StringType()), T.StructField("commission", T.DoubleType())])
ORDER = T.StructType([
    T.StructField("orderId", T.LongType()), T.StructField("time", T.LongType()),
    *(T.StructField(n, T.StringType()) for n in ("symbol", "side", "price", "origQty", "executedQty", "status")), T.StructField("fills", T.ArrayType(FILL)),
])
BY_KIND = {"top": TOP, "trade": TRADE, "depth": DEPTH}
