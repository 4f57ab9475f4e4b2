"""Spark-native analytics for OHLC candle series, with an optional toolkit for training-data pipelines."""
