"""Spark-native prescription text analytics."""
