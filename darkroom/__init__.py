"""Spark-native analytics for large collections of time-stamped media items."""
