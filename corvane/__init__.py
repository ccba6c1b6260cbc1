"""Spark-native text analytics and retrieval engine."""
