"""Waneline: Spark-native analytics for edges that fade over calendar time."""

__version__ = "0.1.0"
