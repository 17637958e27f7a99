"""Spark-native engine for economic-impact datasets."""

__version__ = "0.1.0"
