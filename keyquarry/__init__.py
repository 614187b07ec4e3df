"""Spark-native reading, reshaping and checking of key-value-store snapshots."""

__version__ = "0.1.0"
