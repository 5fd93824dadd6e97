"""Spark-native gene-by-gene sequence typing and corpus processing."""

__version__ = "0.1.0"
