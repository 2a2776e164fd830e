"""Spark-native reconstruction and audit of document tables."""
