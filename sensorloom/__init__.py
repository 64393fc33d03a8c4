"""Spark-native analytics for process time series: window accounting first, monitoring second."""

__version__ = "0.1.0"
