"""Spark-native event operations, retrieval and retrieval-evaluation analytics."""
