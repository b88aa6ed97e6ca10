"""Loreloom: PySpark-native analytics over linked note corpora."""

__version__ = "0.1.0"
