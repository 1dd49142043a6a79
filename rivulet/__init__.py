"""Rivulet: a PySpark-native engine for ordered, timestamped streams."""

__version__ = "0.1.0"
