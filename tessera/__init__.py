"""Spark-native compressed vector search and data preparation."""
