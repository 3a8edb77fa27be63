"""Spark-native full-text search and ranking: DataFrames in, DataFrames out."""
