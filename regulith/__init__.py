"""Spark-native regulatory text analytics."""
