"""Tallyforge: a PySpark-native metric layer and table-history toolkit."""

__version__ = "0.1.0"
