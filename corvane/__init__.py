"""Spark-native corpus preparation and run analytics."""
