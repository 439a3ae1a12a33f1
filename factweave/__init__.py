"""Spark-native analytics over code facts."""
