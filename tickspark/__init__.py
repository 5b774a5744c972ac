"""tickspark: a PySpark-native analytics engine for market-style time-series tables."""
