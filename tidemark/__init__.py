"""Spark-native analytics for market time series and asset fundamentals."""
