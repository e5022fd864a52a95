"""Spark-native multi-scale document retrieval and analytics."""
