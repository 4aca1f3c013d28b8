"""Spark-native analytics for lexical response data."""

__version__ = "0.1.0"
