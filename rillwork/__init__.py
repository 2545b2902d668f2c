"""Spark-native analytics for environmental sample data."""
