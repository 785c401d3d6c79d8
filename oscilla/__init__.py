"""Spark-native analytics over grouped time series."""
