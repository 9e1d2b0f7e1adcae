"""Spark-native analytics for detection-and-tracking tables."""
