"""Spark-native engine for application design metadata and corpus processing."""

__version__ = "0.1.0"
