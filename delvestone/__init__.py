"""Spark-native evidence retrieval and knowledge analytics."""
