"""Spark-native grounded retrieval, verification and evaluation."""

__version__ = "0.1.0"
