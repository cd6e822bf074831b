"""Spark-native decision and engagement analytics."""
