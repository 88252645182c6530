"""Spark-native knowledge-base analytics."""
