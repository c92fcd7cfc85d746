"""Strandlake: a PySpark-native engine for sorted-position, interval and array-valued tables."""
