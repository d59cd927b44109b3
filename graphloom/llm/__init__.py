"""Operators for training-data pipelines. Importing ``queries`` fills ``QUERIES`` and ``ORACLES``."""
