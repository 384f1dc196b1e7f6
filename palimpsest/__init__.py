"""Spark-native memory, retrieval and corpus analytics."""
