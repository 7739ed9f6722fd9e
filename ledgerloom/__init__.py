"""Spark-native analytics for auditable dialogue records."""

__version__ = "0.1.0"
