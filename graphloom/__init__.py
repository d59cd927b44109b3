"""Spark-native analytics for corpora of graphs, curves, optimizer run logs and rasters."""

__version__ = "0.1.0"
