"""Spark-native analytics for indexed text and code."""
