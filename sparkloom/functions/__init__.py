"""Spark-first operators; see README."""
