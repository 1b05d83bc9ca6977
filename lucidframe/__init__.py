"""Spark-native analytics for multi-channel images and array data."""

__version__ = "0.1.0"
