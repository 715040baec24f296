"""Spark-native analytics over code-audit and document tables."""
